"""Queries of the training-data operators for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import ann, bpe, conversations, importance, jaccard_join, packing, quality, secrets, sharding, substring_dedup, token_counts, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_balanced_shards": sharding.op3,
    "op4_bpe_words": bpe.op4,
    "op5_secret_scan": secrets.op5,
    "op6_nn_descent": ann.op6,
    "op7_warc": warc.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_quality_rules": quality.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_importance_resampling": importance.op11,
    "op12_url_filter": url_filter.op12,
    "op13_conversation_repair": conversations.op13,
}

#: What SQL can express of op3, op5 and op12, by the same operators.
QUERIES |= {"shards_by_bytes": sharding.shards_by_bytes, "secret_counts": secrets.secret_counts, "url_rules": url_filter.url_rules}

ORACLES: dict[str, str] = {"op7_warc": warc.ORACLE_OP7, "shards_by_bytes": sharding.ORACLE_SHARDS, "secret_counts": secrets.ORACLE_COUNTS, "op11_importance_resampling": importance.ORACLE_OP11, "op13_conversation_repair": conversations.ORACLE_OP13, "url_rules": url_filter.ORACLE_RULES}
