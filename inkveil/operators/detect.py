"""Detection over tables of pages: one Arrow kernel per batch, relational steps around it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.operators import spans
from inkveil.operators.keys import join_nulls
from inkveil.operators.prefilter import Prefilter
from inkveil.operators.store import spread

REGIONS = "doc_id string, page_number long, ord int, start int, end int, text string, pii_type string, confidence double, source string"
_NAMES = [x.split()[0] for x in REGIONS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]


def _kernel(config: spans.Config, what):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_number", "text")), strict=True):
                for k, s in enumerate(what(text or "", config)):
                    rows.append((doc, page, k, s.start, s.end, s.text, s.kind, s.confidence, getattr(s, "source", "REGEX")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    return run


def _patterns_only(text: str, config: spans.Config) -> list[spans.Span]:
    from inkveil.functions.language import language_py

    return spans.detect_patterns(text, config, language_py(text))


def detect(pages: DataFrame, config: spans.Config = spans.Config()) -> DataFrame:  # noqa: B008
    """Regions of all pages (see REGIONS). Pages are independent: nothing is shuffled, but for pages in
    fewer partitions than there are cores, which are dealt out first.

    Pages under the least length never reach Python."""
    rows = pages.where(F.length(F.trim("text")) >= config.min_chars) if config.min_chars else pages
    return spread(rows.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text")).mapInArrow(_kernel(config, spans.detect_page), REGIONS)


def pattern_spans(pages: DataFrame, config: spans.Config = spans.Config()) -> DataFrame:  # noqa: B008
    """The pattern layer alone, after its sweep."""
    return spread(pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text")).mapInArrow(_kernel(config, _patterns_only), REGIONS)


def count_matches(rows: DataFrame, patterns: dict[int, str]) -> DataFrame:
    """doc_id, pattern, n: how often each pattern that matches a text does; those that cannot are not tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: re.compile(p) for k, p in patterns.items()}
        filter_ = Prefilter(list(compiled.values()))
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                may = filter_.may_match(text or "")
                out += [(doc, k, n) for (k, p), open_ in zip(compiled.items(), may, strict=True) if open_ and (n := sum(1 for _ in p.finditer(text or "")))]
            if out:
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["doc_id", "pattern", "n"])

    return spread(rows.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, pattern int, n long")


def one_pattern(pages: DataFrame, pattern: str, kind: str) -> DataFrame:
    """All matches of one pattern with code-point offsets, by column functions only.

    The text is split at the matches; lengths of what lies before each give its offset."""
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    rows = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page_number", found.alias("m"), F.split("text", pattern).alias("gap"))
    rows = rows.select("doc_id", "page_number", F.posexplode(F.zip_with("m", F.slice("gap", 1, F.size("m")), lambda m, g: F.struct(m.alias("text"), F.length(g).alias("gap")))).alias("ord", "e"), "m", "gap")
    before = F.aggregate(F.slice("gap", 1, F.col("ord") + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice("m", 1, F.col("ord")), F.lit(0), lambda s, m: s + F.length(m))
    return rows.select("doc_id", "page_number", "ord", before.alias("start"), (before + F.length("e.text")).alias("end"), F.col("e.text").alias("text"), F.lit(kind).alias("pii_type"))


def boosts(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans (doc_id, page_number, start, end, pii_type and others) with `boost`, what the words near them add to their confidence.

    Only the text within reach travels with a span."""
    text, reach = pages.select("doc_id", "page_number", F.col("text").alias("__text")), spans.WINDOW + 1
    near = join_nulls(found, text, ["doc_id", "page_number"]).withColumn("__from", F.greatest(F.lit(0), F.col("start") - reach))
    near = near.withColumn("__text", F.substring("__text", F.col("__from") + 1, F.col("end") - F.col("__from") + reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("__text", "__from", "start", "end", "pii_type")), strict=True)
            added = [spans.boost(t, a - at, b - at, kind) for t, at, a, b, kind in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(added, pa.float64())], names=[*batch.schema.names[:-2], "boost"])

    return near.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("boost", T.DoubleType())]))
