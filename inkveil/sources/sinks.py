"""Sinks: documents that are saved, replaced and deleted, and the vault's register of documents and manifests."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replaced(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, but of new ones the last by `order` for each key (of equal ones the one that is greatest as JSON), which
    takes the place of stored ones with that key."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.to_json(F.struct(*new.columns))))
    once = new.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    return stored.join(once.select(key), key, "left_anti").select(*stored.columns).unionByName(once.select(*stored.columns))


class DocumentTable:
    """Documents (rows with an id) in a folder: each save or deletion appends what changed, as one Spark write that
    is there whole or not at all; reading takes the last state of each id: by time, then by the order of the writes (`__seq`, the
    writer's clock), then the row that is greatest as JSON. Rows without an id are not kept."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    def _append(self, rows: DataFrame, at: Column, gone: bool) -> None:
        marked = rows.where(F.col(self.key).isNotNull()).withColumns({"__at": at, "__gone": F.lit(gone), "__seq": F.lit(time.time_ns())})
        marked.write.mode("append").option("mergeSchema", "true").parquet(self.path)

    def save(self, rows: DataFrame, at: Column | None = None) -> None:
        """Save documents; those whose ids are there are replaced."""
        self._append(rows, F.current_timestamp() if at is None else at, False)

    def delete(self, ids: DataFrame, at: Column | None = None) -> None:
        """Delete documents by id; unknown ids do nothing."""
        self._append(ids.select(self.key).distinct(), F.current_timestamp() if at is None else at, True)

    def read(self) -> DataFrame:
        """All documents as last saved."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        seq = F.col("__seq") if "__seq" in rows.columns else F.lit(0)
        last = Window.partitionBy(self.key).orderBy(F.desc("__at"), F.desc(F.coalesce(seq, F.lit(0))), F.desc(F.to_json(F.struct(*rows.columns))))
        live = rows.withColumn("__r", F.row_number().over(last)).where("__r = 1 AND NOT __gone")
        return live.drop("__r", "__at", "__gone", "__seq")

    def compact(self, path: str) -> DocumentTable:
        """The same documents in a new folder, without what was replaced or deleted."""
        out = DocumentTable(self.spark, path, self.key)
        out.save(self.read())
        return out


def register(documents: DataFrame, done: DataFrame) -> DataFrame:
    """The vault's documents (doc_id, original_filename, anonymized_filename, processed_at, page_count) with those just processed."""
    return replaced(documents, done, "doc_id", "processed_at")


def delete_tokens(vault: DataFrame, chosen: DataFrame) -> DataFrame:
    """The vault without the chosen tokens (token_id)."""
    return vault.join(chosen.select("token_id").distinct(), "token_id", "left_anti").select(*vault.columns)


def manifest(tokens: DataFrame) -> DataFrame:
    """doc_id and `value`, a JSON object with the document's tokens in page order, to be written beside its output.

    Of tokens: doc_id, page_number, start, token_string, text, pii_type."""
    entry = F.struct("page_number", "start", "token_string", F.col("text").alias("original_text"), "pii_type")
    listed = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("tokens"))
    return listed.select("doc_id", F.to_json(F.struct("doc_id", "tokens")).alias("value"))
