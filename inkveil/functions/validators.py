"""Check-digit and structure validators, as column expressions and as plain functions for kernels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.lexicon.words import BIC_COUNTRIES, BIC_WORDS


def digits_of(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), "(?!$)"), lambda d: d.cast("int"))


def _weighted(digits: Column, weights: list[int]) -> Column:
    ws = F.array(*map(F.lit, weights))
    pairs = F.zip_with(F.slice(digits, 1, len(weights)), ws, lambda d, w: d * w)
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def luhn(text: Column) -> Column:
    """Luhn sum divisible by ten, thirteen digits at least."""
    d = F.reverse(digits_of(text))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 13) & (F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0)


def iban(text: Column) -> Column:
    """ISO 7064 modulo 97, folded digit by digit (letters count as two digits)."""
    clean = F.upper(F.regexp_replace(text, "[ -]", ""))
    turned = F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    left = F.aggregate(F.split(turned, "(?!$)"), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + value(c)) % 97).otherwise((s * 100 + value(c)) % 97))
    return clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (left == 1)


def _nine(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s.\-]", "")


def bsn(text: Column) -> Column:
    d = _nine(text)
    total = _weighted(digits_of(d), [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return d.rlike("^[0-9]{9}$") & (total % 11 == 0) & (total != 0)


def nif(text: Column) -> Column:
    d = _nine(text)
    rest = _weighted(digits_of(d), [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return d.rlike("^[12356789][0-9]{8}$") & (F.substring(d, 9, 1).cast("int") == F.when(rest < 2, 0).otherwise(11 - rest))


def nhs(text: Column) -> Column:
    d = _nine(text)
    check = 11 - _weighted(digits_of(d), [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return d.rlike("^[0-9]{10}$") & (check != 10) & (F.substring(d, 10, 1).cast("int") == F.when(check == 11, 0).otherwise(check))


def piva(text: Column) -> Column:
    d = _nine(text)
    summed = F.aggregate(F.transform(digits_of(d), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.floor(x * 2 / 10).cast("int") + (x * 2) % 10)), F.lit(0), lambda s, x: s + x)
    return d.rlike("^[0-9]{11}$") & (summed % 10 == 0)


def niss(text: Column) -> Column:
    d = _nine(text)
    check = (10 - _weighted(digits_of(d), [29, 23, 19, 17, 13, 11, 7, 5, 3, 2]) % 10) % 10
    return d.rlike("^[0-9]{11}$") & ~d.rlike(r"^(.)\1+$") & (F.substring(d, 11, 1).cast("int") == check)


def french_nir(text: Column) -> Column:
    d = F.regexp_replace(text, r"\s", "")
    return d.rlike("^[12][0-9]{12}([0-9]{2})?$") & F.substring(d, 4, 2).cast("int").between(1, 99) & F.substring(d, 6, 2).cast("int").between(1, 99)


def bic(text: Column) -> Column:
    c = F.upper(F.trim(text))
    return c.rlike("^[A-Z]{4}.{4}(.{3})?$") & F.substring(c, 5, 2).isin(BIC_COUNTRIES)


def plausible_date(text: Column) -> Column:
    """Three numbers, month 1 to 12 and day 1 to 31 in the order that the numbers suggest."""
    p = F.split(text, r"[/\-.]")
    a, b, c = (F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    year_last = (c > 31) | (F.length(F.try_element_at(p, F.lit(3))) == 4)
    month = F.when(a > 31, b).when(year_last & (a > 12), b).otherwise(a)
    day = F.when(a > 31, c).when(year_last & (a > 12), a).otherwise(b)
    return F.coalesce((F.size(p) == 3) & month.between(1, 12) & day.between(1, 31), F.lit(False))


# The same checks for kernels.


def luhn_ok(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()][::-1]
    return len(d) >= 13 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def iban_ok(text: str) -> bool:
    c = text.replace(" ", "").replace("-", "").upper()
    return bool(15 <= len(c) <= 34 and c[:2].isalpha() and c[2:4].isdigit()) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def _sum(digits: str, weights: list[int] | range) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights, strict=False))


def bsn_ok(d: str) -> bool:
    total = _sum(d, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return total % 11 == 0 and total != 0


def nif_ok(d: str) -> bool:
    rest = _sum(d[:8], range(9, 1, -1)) % 11
    return d[0] in "12356789" and int(d[8]) == (0 if rest < 2 else 11 - rest)


def nhs_ok(d: str) -> bool:
    check = 11 - _sum(d[:9], range(10, 1, -1)) % 11
    return check != 10 and int(d[9]) == check % 11


def piva_ok(d: str) -> bool:
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d)) % 10 == 0


def niss_ok(d: str) -> bool:
    return len(set(d)) > 1 and int(d[10]) == -_sum(d[:10], [29, 23, 19, 17, 13, 11, 7, 5, 3, 2]) % 10


def date_ok(text: str) -> bool:
    parts = re.split(r"[/\-\.]", text)
    if len(parts) != 3 or not all(x.isdigit() for x in parts):
        return False
    a, b, c = map(int, parts)
    if a > 31:
        month, day = b, c
    elif (c > 31 or len(parts[2]) == 4) and a > 12:
        month, day = b, a
    else:
        month, day = a, b
    return 1 <= month <= 12 and 1 <= day <= 31


def accepted(value: str, kind: str) -> bool:
    """Whether a matched value passes the checks of its type; types without checks pass."""
    clean = value.strip()
    if kind == "CREDIT_CARD":
        return luhn_ok(value)
    if kind == "DATE":
        return date_ok(value) if re.match(r"^\d{1,4}[/\-\.]\d{1,2}[/\-\.]\d{1,4}$", value) else True
    if kind == "IBAN":
        c = value.replace(" ", "").replace("-", "").upper()
        return iban_ok(value) if len(c) >= 15 and c[:2].isalpha() and c[2:4].isdigit() else True
    if kind == "SSN":
        d = re.sub(r"\s", "", value)
        if len(d) in (13, 15) and d[0] in "12" and not (d[3:7].isdigit() and 1 <= int(d[3:5]) <= 99 and 1 <= int(d[5:7]) <= 99):
            return False
        if re.match(r"^\d{9}$", clean) and not (bsn_ok(clean) or nif_ok(clean)):
            return False
        if re.match(r"^\d{10}$", re.sub(r"\s", "", clean)) and not nhs_ok(re.sub(r"\s", "", clean)):
            return False
        return not re.match(r"^\d{11}$", clean) or niss_ok(clean)
    if kind == "CUSTOM":
        up = clean.upper()
        if re.match(r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$", up) and (up[4:6] not in BIC_COUNTRIES or up in BIC_WORDS):
            return False
        return not re.match(r"^\d{11}$", clean) or piva_ok(clean)
    return True
