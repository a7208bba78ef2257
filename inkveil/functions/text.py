"""Text functions as column expressions; Arrow functions where Spark has no Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose base form decomposition does not give; quotes; dashes.
SPECIAL = {"ß": "s", "ẞ": "S", "æ": "a", "Æ": "A", "œ": "o", "Œ": "O", "ð": "d", "Ð": "D", "þ": "t", "Þ": "T", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i"}
QUOTES = "\"'‘’‚‛“”„‟«»‹›"
APOSTROPHES, DASHES = "‘’‚‛ʼʹˈ`´＇", "‐‑‒–—―﹘﹣－"


def base_letter(ch: str) -> str:
    """One character without its marks; always one character, so that offsets stay valid."""
    if ch in SPECIAL:
        return SPECIAL[ch]
    base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
    return base if len(base) == 1 else ch


class Letters(dict):
    """What single characters become, worked out when first met."""

    def __init__(self, change):
        self.change = change

    def __missing__(self, code: int) -> str:
        self[code] = c = self.change(chr(code))
        return c


_BASE = Letters(base_letter)
_SEARCHED = Letters(lambda c: " " if (b := base_letter(c)) in QUOTES else b)


def strip_accents_py(text: str) -> str:
    return text if text.isascii() else text.translate(_BASE)


def plain_py(text: str) -> str:
    """The form in which terms and values are searched, without accents and with quotes as spaces; as long as the text."""
    if not text.isascii():
        changed = {c: b for c in set(text) if (b := _SEARCHED[ord(c)]) != c}
        if len(changed) <= 40 and changed.keys().isdisjoint(changed.values()):  # far faster than a look at each character
            for c, b in changed.items():
                text = text.replace(c, b)
            return text
    return text.translate(_SEARCHED)


@cache
def accented() -> tuple[str, str]:
    """All characters that base_letter changes, and what it makes of them."""
    changed = {c: base_letter(c) for c in (*SPECIAL, *(chr(i) for i in (*range(0xC0, 0x20000), *range(0x2F800, 0x2FA20)) if unicodedata.decomposition(chr(i))))}
    changed = {c: b for c, b in changed.items() if c != b}
    return "".join(changed), "".join(changed.values())


def strip_accents(text: Column | str) -> Column:
    """strip_accents_py as a column function: characters one by one, so lengths stay."""
    return F.translate(text, *accented())


def remove_accents_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def remove_accents(text: pd.Series) -> pd.Series:
    return text.map(remove_accents_py, na_action="ignore")


# Letters that stand for others where a PDF's encoding was lost.
PDF_WRONG, PDF_RIGHT = "ÚúÞþÔŒ", "ééèèôœ"


def repair_pdf(text: Column) -> Column:
    """Letters put right that a PDF without a proper encoding gives wrongly."""
    return F.translate(text, PDF_WRONG, PDF_RIGHT)


def repair_pdf_py(text: str) -> str:
    return text.translate(str.maketrans(PDF_WRONG, PDF_RIGHT))


def mojibake_py(text: str) -> str:
    """UTF-8 that was read as Latin-1, read again where that is valid."""
    try:
        return text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return text


_PLAIN = str.maketrans(APOSTROPHES + DASHES, "'" * len(APOSTROPHES) + "-" * len(DASHES))


def matching_form(text: str) -> str:
    """The form in which two texts are compared: plain quotes and dashes, no accents, lower case, single spaces."""
    text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).lower().split())


@F.pandas_udf(T.StringType())
def normalize_for_matching(text: pd.Series) -> pd.Series:
    return text.map(matching_form, na_action="ignore")


def ws_collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, "")


def neutralise_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, " " * len(QUOTES))


def context_snippet(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """The text around [start, end), with dots where it is cut."""
    lo, hi = F.greatest(F.lit(0), start - around), F.least(F.length(text), end + around)
    return F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), "...").otherwise(""))


def mojibake_repair(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again as UTF-8 where that is valid."""
    fits = ~text.rlike("[^\\x00-\\xff]")
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return F.when(fits & F.is_valid_utf8(F.decode(F.encode(text, "ISO-8859-1"), "ISO-8859-1")) & ~F.contains(again, F.lit("�")), again).otherwise(text)


#: What each part of a pattern template stands for; `count` letters or digits, `value` as it is.
TEMPLATE_PARTS = {"letters": "[a-zA-Z]", "LETTERS": "[A-Z]", "digits": r"\d", "alphanumeric": "[a-zA-Z0-9]", "any": "."}


def flex_pattern(key: str) -> re.Pattern:
    """A pattern for a normalised key: any white space between words, bounded by non-word characters."""
    body = r"\s+".join(re.escape(w) for w in key.split(" "))
    head = r"\b" if key[:1].isalnum() else r"(?<!\w)"
    tail = r"\b" if key[-1:].isalnum() else r"(?!\w)"
    return re.compile(head + body + tail, re.IGNORECASE)


def version_array(version: Column) -> Column:
    """A dotted version as an array of numbers, for comparison; missing parts count as 0."""
    parts = F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
