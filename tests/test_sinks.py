from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from inkveil.sources import sinks


def test_documents_are_saved_replaced_and_deleted(spark, tmp_path):
    store = sinks.DocumentTable(spark, f"file://{tmp_path}/docs")
    at = lambda n: F.timestamp_seconds(F.lit(n))
    store.save(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_id string, v int"), at(1))
    store.save(spark.createDataFrame([("a", 4)], "doc_id string, v int"), at(2))
    store.delete(spark.createDataFrame([("b",), ("zz",)], "doc_id string"), at(3))
    assert sorted(map(tuple, store.read().collect())) == [("a", 4)]
    store.save(spark.createDataFrame([("b", 5, "new")], "doc_id string, v int, more string"), at(4))
    assert sorted((r.doc_id, r.v) for r in store.read().collect()) == [("a", 4), ("b", 5)]
    assert sorted((r.doc_id, r.v) for r in store.compact(f"file://{tmp_path}/small").read().collect()) == [("a", 4), ("b", 5)]


def test_register_tokens_and_manifest(spark):
    kind = "doc_id string, original_filename string, anonymized_filename string, processed_at timestamp, page_count int"
    t = lambda n: datetime(2024, 1, n)
    out = sinks.register(spark.createDataFrame([("a", "x", "", t(1), 1), ("b", "y", "", t(1), 1)], kind), spark.createDataFrame([("a", "x", "z", t(2), 3), ("a", "x", "w", t(3), 4)], kind))
    assert sorted((r.doc_id, r.anonymized_filename, r.page_count) for r in out.collect()) == [("a", "w", 4), ("b", "", 1)]
    vault = spark.createDataFrame([("1", "[E00001]"), ("2", "[E00002]")], "token_id string, token_string string")
    assert [r.token_id for r in sinks.delete_tokens(vault, vault.where("token_id = '1'").union(vault.where("token_id = '1'"))).collect()] == ["2"]
    tokens = spark.createDataFrame([("d", 2, 0, "[E00002]", "b@x", "EMAIL"), ("d", 1, 5, "[E00001]", "a@x", "EMAIL")], "doc_id string, page_number int, start int, token_string string, text string, pii_type string")
    row = sinks.manifest(tokens).first()
    assert [x["original_text"] for x in json.loads(row.value)["tokens"]] == ["a@x", "b@x"]
    assert sinks.manifest(tokens.limit(0)).count() == 0


def test_later_writes_of_one_time_win(spark, tmp_path):
    from pyspark.sql import functions as F

    from inkveil.sources.sinks import DocumentTable

    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    held = DocumentTable(spark, f"file://{tmp_path}/documents")
    for k in range(3):
        held.save(spark.createDataFrame([("a", f"v{k}"), ("b", f"v{k}")], "doc_id string, text string"), at)
    held.delete(spark.createDataFrame([("b",)], "doc_id string"), at)
    assert [tuple(r) for r in held.read().collect()] == [("a", "v2")]
    held.save(spark.createDataFrame([("b", "x"), ("b", "y")], "doc_id string, text string"), at)
    assert {tuple(r) for r in held.read().collect()} == {("a", "v2"), ("b", "y")}
