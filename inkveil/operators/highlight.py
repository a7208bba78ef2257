"""Highlight-all: every further occurrence of a chosen region's text in its document; and spans cut to what a user wrote."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import matching_form, normalize_for_matching

# Likeness of texts, characters that windows must share, cover that makes an occurrence known, and
# the share of its length that a covering text needs.
LIKENESS, SHARED, COVER, LENGTH = 0.75, 0.60, 0.40, 0.85


def mapped(text: str) -> tuple[str, list[int]]:
    """matching_form of a text, and for each of its characters the place of the one that it comes from."""
    out, places = [], []
    for i, c in enumerate(text):
        form = matching_form(c)
        if c.isspace() or (not form and unicodedata.normalize("NFKD", c).isspace()):
            if out and out[-1] != " ":
                out.append(" ")
                places.append(i)
            continue
        for x in form:
            out.append(x)
            places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def occurrences(needle: str, text: str) -> list[tuple[int, int]]:
    """Places of a text, whatever its case, accents and white space; if there are none, of windows up to two
    characters longer or shorter that are like it, those of its own length first, none near another."""
    want = matching_form(needle)
    low, places = mapped(text)
    if not want:
        return []
    n = len(want)
    original = lambda a, b: (places[a], places[b] if b < len(places) else len(text))
    found, at = [], low.find(want)
    while at >= 0:
        found.append(original(at, at + n))
        at = low.find(want, at + 1)
    if found or n < 2:
        return found
    letters = Counter(want)
    for size in (n, n + 1, n - 1, n + 2, n - 2):
        if size < 2 and size != n:
            continue
        for i in range(len(low) - size + 1):
            window = low[i : i + size]
            if sum((letters & Counter(window)).values()) >= n * SHARED and likeness(want, window) >= LIKENESS:
                a, b = original(i, i + size)
                if all(abs(a - x) >= max(n // 2, 2) for x, _ in found):
                    found.append((a, b))
    return found


FOUND = "needle_id string, doc_id string, page_number long, start int, end int, text string"


def find_all(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of FOUND for the texts of chosen (region_id, doc_id, text) on all pages of their documents."""
    needles = chosen.select(F.col("region_id").cast("string").alias("needle_id"), F.col("doc_id").cast("string"), F.col("text").alias("needle"))
    rows = pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text").join(needles, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, page, text, who, needle in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_number", "text", "needle_id", "needle")), strict=True):
                out += [(who, doc, page, a, b, text[a:b]) for a, b in occurrences(needle or "", text or "")]
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def highlight_all(chosen: DataFrame, regions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, cancelled): manual regions for all occurrences of the chosen regions' texts that no region covers,
    and the ids of regions inside new ones whose texts are parts of theirs.

    regions: region_id, doc_id, page_number, start, end, text, pii_type, confidence, action; cancelled ones count
    for nothing. A region covers an occurrence if it overlaps it with the same text, or overlaps more than COVER of
    it with a text not much shorter. Rows of chosen (region_id) that name no region give nothing."""
    live = regions.where("action <> 'CANCEL'")
    source = regions.join(chosen.select("region_id").distinct(), "region_id")
    found = find_all(source, pages).withColumn("key", normalize_for_matching("text"))
    held = live.select("region_id", F.col("doc_id").cast("string").alias("__doc"), F.col("page_number").cast("long").alias("__page"), F.col("start").alias("__start"), F.col("end").alias("__end"), normalize_for_matching("text").alias("__key"))
    met = (F.col("doc_id") == F.col("__doc")) & (F.col("page_number") == F.col("__page")) & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end"))
    shared = F.least("end", "__end") - F.greatest("start", "__start")
    covers = (F.col("key") == F.col("__key")) | ((F.length("__key") >= F.length("key") * LENGTH) & (shared > COVER * (F.col("end") - F.col("start"))))
    fresh = found.join(held, met & covers, "left_anti")
    kind = source.select(F.col("region_id").cast("string").alias("needle_id"), "pii_type", "confidence")
    new = fresh.join(kind, "needle_id").groupBy("doc_id", "page_number", "start", "end").agg(F.min(F.struct("needle_id", "text", "pii_type", "confidence")).alias("r"))
    new = new.select("doc_id", "page_number", "start", "end", "r.text", "r.pii_type", "r.confidence", F.lit("MANUAL").alias("source"), F.lit("PENDING").alias("action"))
    inside = held.join(fresh.select("doc_id", "page_number", "start", "end", "key"), met & (F.col("__key") != "") & (F.col("__key") != F.col("key")) & F.contains("key", "__key"))
    return new, inside.select("region_id").distinct()


def trim(text: str, expressions: list[str]) -> str:
    """A found text cut to the user's expression that it starts with, if more than a word's rest follows."""
    low, places = mapped(text)
    for e in {matching_form(x): None for x in expressions}:
        if e and len(low) > len(e) and low.startswith(e) and not low[len(e)].isalpha():
            return text[: places[len(e)]].rstrip()
    return text
