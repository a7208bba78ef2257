"""Relational queries over regions, documents, the vault and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_by_type(regions: DataFrame) -> DataFrame:
    return regions.groupBy("pii_type").agg(F.count("*").alias("n"))


def top_texts(regions: DataFrame, k: int) -> DataFrame:
    """The k most frequent texts of each type; ties by text."""
    n = regions.groupBy("pii_type", "text").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("pii_type").orderBy(F.desc("n"), "text"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def protected_documents(regions: DataFrame) -> DataFrame:
    """Documents without pending regions and with at least one hidden region."""
    counts = regions.groupBy("doc_id").agg(F.count("*").alias("regions_count"), F.count_if(F.col("action") == "PENDING").alias("pending"), F.count_if(F.col("action").isin("REMOVE", "TOKENIZE")).alias("hidden"))
    return counts.select("doc_id", "regions_count", ((F.col("pending") == 0) & (F.col("hidden") > 0)).alias("is_protected"))


def status_counts(regions: DataFrame) -> DataFrame:
    return regions.agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("PENDING", "REMOVE", "TOKENIZE", "CANCEL")])


def page_of(rows: DataFrame, page: int, limit: int, *order) -> DataFrame:
    """One page of a sorted listing; pages start at 1, limits lie within 1 and 1000."""
    page, limit = max(1, page), min(max(1, limit), 1000)
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
