"""Language detection by stop-word share, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.lexicon.words import STOP_WORDS, WORD_EDGES

SAMPLE, LEAST_WORDS, LEAST_SHARE = 2000, 20, 0.10


def sample_words(text: Column) -> Column:
    """Lower-case words of two characters or more in the first 2000 characters, without edge punctuation."""
    words = F.split(F.trim(F.regexp_replace(F.substring(text, 1, SAMPLE), r"(?U)\s+", " ")), " ")
    edges = "".join("\\" + c if c in "[]-^\\" else c for c in WORD_EDGES)
    clean = F.transform(words, lambda w: F.regexp_replace(F.lower(w), f"^[{edges}]+|[{edges}]+$", ""))
    return F.filter(clean, lambda w: F.length(w) >= 2)


def language(text: Column) -> Column:
    """The language with the largest share of stop words; "en" for short texts and shares under a tenth.

    Ties go to the language listed first. The words, and then the hits, are bound as the variable of a
    lambda, so each is computed once for a row however often it is used."""
    codes = F.array(*(F.lit(code) for code in STOP_WORDS))

    def best(words: Column, hits: Column) -> Column:
        n, most = F.size(words), F.array_max(hits)
        found = F.element_at(codes, F.array_position(hits, most).cast("int"))
        return F.when((n < LEAST_WORDS) | (most / n < LEAST_SHARE), F.lit("en")).otherwise(found)

    def counted(words: Column) -> Column:
        hits = F.array(*(F.size(F.filter(words, _in(stops))) for stops in STOP_WORDS.values()))
        return _once(hits, lambda h: best(words, h))

    return _once(sample_words(text), counted)


def _once(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _in(stops: str):
    listed = sorted(set(stops.split()))
    return lambda w: w.isin(listed)


def language_py(text: str) -> str:
    """The same for kernels."""
    words = [w for x in text[:SAMPLE].lower().split() if len(w := x.strip(WORD_EDGES)) >= 2]
    if len(words) < LEAST_WORDS:
        return "en"
    best, share = "en", 0.0
    for code, stops in _SETS.items():
        now = sum(map(stops.__contains__, words)) / len(words)
        if now > share:
            best, share = code, now
    return best if share >= LEAST_SHARE else "en"


_SETS = {code: frozenset(stops.split()) for code, stops in STOP_WORDS.items()}
