"""Substring dedup with difference-cover anchors.

A window of W words of one document is removed where the same word sequence also starts in a
document with a smaller id. Short anchor windows are hashed only at word positions whose residue
modulo the period P lies in a difference cover: for any two positions i and j there is a shift
d < P with i + d and j + d both on the cover, so two equal windows of W words share an aligned
anchor of W - P + 1 words inside them. Anchors seen once can be in no match; only windows around
anchors seen at least twice are hashed in full (128 bits), and the least id per hash decides.

Exact copies of a whole text are settled by a digest of the text before any window is looked at.

Defined results: a null text has no words; a text of fewer than W words loses none; ids that are
null neither remove words nor lose any; rows with equal ids do not remove each other's words;
repeated rows each give a row with the same result; other columns are carried in `row`, whatever
their names; an empty table gives an empty result. Windows are judged on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import Scratch, Words, arrow, load, ranges, release, signed, tune, utf8, whole, windows

#: Perfect difference sets modulo 1, 7, 13, 31 and 57.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least a third of the window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= max(2, window // 3))
    return period, COVERS[period]


def _anchors(window: int):
    period, cover = cover_for(window)
    length = window - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Words.of(batch.column("text"))
        h = windows(w.hashes(), length)
        if not len(h):
            return None
        doc, counts = w.doc()[: len(h)], w.counts()
        pos = np.arange(len(h)) - w.first[doc]
        keep = on_cover[pos % period] & (pos + length <= counts[doc]) & (counts[doc] >= window)
        rk = batch.column("rk").to_numpy()
        return pa.record_batch([pa.array(signed(h[keep])), pa.array(rk[doc[keep]]), pa.array(pos[keep].astype(np.int32))], names=["h", "rk", "pos"])

    return kernel


def _candidates(window: int):
    period, _ = cover_for(window)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Words.of(batch.column("text"))
        counts = w.counts()
        lists = batch.column("marks")
        n_marks = np.diff(np.asarray(lists.offsets))
        marks = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(marks) or len(w.starts) < window:
            return None
        doc = np.repeat(np.arange(w.n_docs), n_marks)
        # Windows that hold the anchor: they start up to period - 1 words before it.
        lo = np.maximum(marks - period + 1, 0)
        hi = np.minimum(marks, counts[doc] - window)
        hit = np.zeros(len(w.starts) + 1, np.int64)
        ok = hi >= lo
        np.add.at(hit, w.first[doc[ok]] + lo[ok], 1)
        np.add.at(hit, w.first[doc[ok]] + hi[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(hit) > 0)
        h1, h2 = windows(w.hashes(0), window, 0)[at], windows(w.hashes(1), window, 1)[at]
        d = w.doc()[at]
        ids, rk = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("rk").to_numpy()
        return pa.record_batch([pa.array(signed(h1)), pa.array(signed(h2)), pa.array(ids[d]), pa.array(rk[d]), pa.array((at - w.first[d]).astype(np.int32))], names=["h1", "h2", "doc_id", "rk", "pos"])

    return kernel


def _cut(window: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = utf8(batch.column("text"))
        raw = data.tobytes()
        n_words, n_removed, kept = [], [], []
        marks, copies = batch.column("marks"), batch.column("copy").to_pylist()
        for i in range(batch.num_rows):
            words = raw[offs[i] : offs[i + 1]].split()
            n = len(words)
            n_words.append(n)
            if copies[i] and n >= window:
                words = []
            elif marks[i].is_valid:
                starts = marks[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                gone = np.zeros(n, bool)
                gone[ranges(starts, np.full(len(starts), window))] = True
                words = [words[j] for j in np.flatnonzero(~gone)]
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.record_batch([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], names=["row", "n_words", "n_removed", "kept_text"])

    return kernel


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: `row` (a struct of the columns in carry, all by default), n_words,
    n_removed and kept_text (the kept words, joined by one space).

    Texts are shuffled twice, by row key: once for those with a repeated anchor, once to cut.
    No group of equal windows ever meets in one task: least ids are partial aggregates, and hits
    come back by a plain join, which Spark splits where it is skewed."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "substrings")
    base = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    base = base.withColumn("rk", F.xxhash64("doc_id", "text"))
    owned = base.where("doc_id IS NOT NULL").select("rk", "doc_id", "text")

    named = owned.select("rk", "doc_id", F.md5("text").alias("digest"))
    first = scratch.save(named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "texts")
    copies = scratch.save(named.join(first, "digest").where("doc_id > least").select("rk", "doc_id").distinct(), "copies")

    anchors = arrow(owned.select("rk", "text"), _anchors(window), "h long, rk long, pos int")
    repeated = scratch.save(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    marks = anchors.join(repeated, "h").groupBy("rk").agg(F.collect_set("pos").alias("marks"))
    marks = scratch.save(marks.join(copies, "rk", "left_anti"), "marks")

    cand = arrow(owned.join(marks, "rk"), _candidates(window), "h1 long, h2 long, doc_id long, rk long, pos int")
    cand = scratch.save(cand, "windows")
    least = cand.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    least = scratch.save(least, "least")
    hits = cand.join(least, ["h1", "h2"]).where("doc_id > least")
    hits = scratch.save(hits.groupBy("rk", "doc_id").agg(F.collect_set("pos").alias("marks")), "hits")
    scratch.drop("windows")

    # A row is named by its id and 64 bits of its text, a clash of which needs two texts of one id.
    cut = base.join(hits, ["rk", "doc_id"], "left").join(copies.withColumn("copy", F.lit(True)), ["rk", "doc_id"], "left")
    cut = cut.select("row", F.col("doc_id"), "text", "marks", (F.coalesce("copy", F.lit(False)) & F.col("doc_id").isNotNull()).alias("copy"))
    cut = cut.withColumn("marks", F.when(F.col("doc_id").isNotNull(), F.col("marks"))).drop("doc_id")
    schema = T.StructType([cut.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    release(spark)
    return arrow(cut, _cut(window), schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
