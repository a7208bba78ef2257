"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, secret scans, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import stages
from inkveil.llm.common import Scratch, load

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("substring_dedup", stages.substrings),
    ("secret_scan", stages.masked_secrets),
    ("best_fit_packing", stages.packed),
]

#: Expectation-maximisation, similarity joins and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
