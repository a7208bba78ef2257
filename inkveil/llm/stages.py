"""Stages of the corpus pipeline: operators applied to documents, their decisions carried out.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. Nulls, empty texts, repeated rows, empty tables and further columns behave as the operator of
the stage defines; further columns are carried along.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import jaccard_join, packing, quality, secrets, substring_dedup
from inkveil.llm.common import Scratch, arrow, row_key, whole

#: Near duplicates in the pipeline: five-word shingles, Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def retold(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of `row`, with the text column replaced by `text` and n_chars, if any, made to fit."""
    text = F.col(text)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return quality.judge(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id, unchanged; documents without words stay.

    Rows that repeat the least id of a group give one row, any of them. Documents with a null id
    that are linked with nothing stay; of linked ones without any id one stays."""
    found = jaccard_join.jaccard_components(docs, NEAR_NUM, NEAR_DEN, NEAR_WORDS)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
    kept = first.groupBy("group").agg(F.min(F.struct("r1", "r2")).alias("r")).select("r.r1", "r.r2")
    empty = found.where("n_shingles = 0").select("r1", "r2").distinct()
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).select("row", *row_key("doc_id", "text"))
    rows = named.join(kept, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("row").alias("row"))
    return rows.select("row.*").unionByName(named.join(empty, ["r1", "r2"], "left_semi").select("row.*"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; untouched texts keep their white space, and those of which nothing is left go."""
    out = substring_dedup.dedup_substrings(docs).where("n_removed < n_words OR n_words = 0")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")))
    return retold(out, docs.columns, "text")


def _mask(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = []
    for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
        if spans:
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["end"] > at:
                    parts += [text[at : s["start"]], "[SECRET]"] if s["start"] >= at else []
                    at = s["end"]
            text = "".join([*parts, text[at:]])
        texts.append(text)
    return pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret found is replaced by [SECRET]."""
    found = secrets.scan_secrets(docs, Scratch(spark, "secrets").path("ledger"))
    clean = retold(found.where("size(secrets.ranges) = 0").withColumn("text", F.col("row.text")), docs.columns, "text")
    hit = found.where("size(secrets.ranges) > 0").select("row", F.col("row.text").alias("text"), F.col("secrets.ranges").alias("ranges"))
    return clean.unionByName(retold(arrow(hit, _mask, hit.select("row", "text").schema), docs.columns, "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a sequence."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = packing.pack_documents(docs, *paths, carry=["doc_id"])
    return out.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
