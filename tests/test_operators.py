from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkveil import queries
from inkveil.operators import detect, document, spans, vault
from inkveil.streaming.limiter import Limiter, rate_limited

PAGES = [("d", 1, "Contact jane@example.org about the offer, please. Patient: Mary Jones"), ("d", 2, "nothing but a word that MARY  JONES wrote and jane@EXAMPLE.org again"), ("e", 1, "Only a short note about nothing in particular, no data."), ("e", 2, ""), ("f", 1, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, page_number long, text string")


def test_detect_and_propagate(spark, pages):
    config = spans.Config(language="en")
    found = detect.detect(pages.where("text IS NOT NULL"), config)
    first = {(r.page_number, r.pii_type, r.text) for r in found.where("doc_id = 'd' AND page_number = 1").collect()}
    assert {(1, "EMAIL", "jane@example.org"), (1, "PERSON", "Mary Jones")} <= first
    everywhere = document.propagate(found, pages.where("text IS NOT NULL")).where("doc_id = 'd' AND page_number = 2").collect()
    assert {"MARY  JONES"} <= {r.text for r in everywhere}
    assert not document.propagate(found, pages.where("text IS NOT NULL")).where("doc_id = 'e'").count()


def test_one_pattern_offsets(spark):
    df = spark.createDataFrame([("a", 1, "😀é 1.2.3.4 and 5.6.7.8")], "doc_id string, page_number long, text string")
    rows = detect.one_pattern(df, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "IP_ADDRESS").orderBy("ord").collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(3, 10, "1.2.3.4"), (15, 22, "5.6.7.8")]


def regions(spark, rows):
    return spark.createDataFrame(rows, detect.REGIONS)


def test_unify_contained_sweep(spark):
    r = regions(spark, [("d", 1, 0, 0, 4, "Acme", "ORG", 0.9, "NER"), ("d", 2, 0, 5, 9, "acme", "PERSON", 0.6, "NER"), ("d", 3, 0, 0, 2, "77", "ORG", 0.9, "NER"), ("d", 4, 0, 0, 9, "Acme Inc.", "ORG", 0.9, "NER"), ("d", 4, 1, 0, 4, "Acme", "ORG", 0.8, "NER")])
    assert {x.pii_type for x in document.unify_types(r).where("lower(text) = 'acme'").collect()} == {"ORG"}
    assert document.drop_contained(r).where("page_number = 4").count() == 1
    assert document.final_sweep(r).where("page_number = 3").count() == 0


def test_tokens_redaction_round_trip(spark, pages):
    p = pages.where("text IS NOT NULL")
    r = detect.one_pattern(p, r"[a-z]+@[A-Za-z.]+", "EMAIL").withColumn("action", F.lit("TOKENIZE"))
    minted = vault.mint_tokens(r)
    assert minted.select("token_string").distinct().count() == minted.count() == 2
    hidden = vault.redact(p, minted)
    assert not hidden.where("text LIKE '%@%'").count() and hidden.agg(F.sum("tokens_created")).first()[0] == 2
    rows = vault.vault_rows(minted, p, F.current_timestamp())
    back = vault.detokenize(hidden.select("doc_id", "page_number", "text"), rows)
    assert {(x.doc_id, x.page_number, x.text) for x in back.collect()} == {x for x in PAGES if x[2] is not None}
    again = vault.mint_tokens(r, rows)
    assert not {x.token_string for x in again.collect()} & {x.token_string for x in minted.collect()}
    counts = vault.import_tokens(rows.limit(0), rows.unionByName(rows))[1].first()
    assert (counts.imported, counts.skipped, counts.errors) == (2, 2, 0)


def test_unresolved_tokens_stay(spark):
    p = spark.createDataFrame([("d", 1, "[P00001] and [P00001] and [E12345]")], "doc_id string, page_number long, text string")
    v = spark.createDataFrame([("[E12345]", "a@b.c")], "token_string string, original_text string")
    row = vault.detokenize(p, v).first()
    assert (row.text, row.tokens_replaced, row.unresolved) == ("[P00001] and [P00001] and a@b.c", 2, ["[P00001]"])


def test_limiter_forgets_rejected_hits(spark):
    rule = Limiter(2, 10)
    assert [rule.allow(t) for t in (0, 1, 2, 10, 10.5, 11.5)] == [True, True, False, False, True, True]
    rows = [(i, 1, float(t)) for i, t in enumerate((0, 1, 2, 10, 10.5, 11.5))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    assert [r.allowed for r in rate_limited(df, 2, 10).orderBy("event_id").collect()] == [True, True, False, False, True, True]


def test_parts_of_firm_names():
    from inkveil.operators.partial import groups_of, parts_of

    assert groups_of(["360", "Capital", "747", "Group"]) == [["360", "Capital", "747"], ["Group"]]
    assert parts_of("Deutsche Bank AG") == ["deutsche bank", "bank ag", "deutsche", "bank"] and parts_of("Acme Inc") == []
    assert "bank" not in parts_of("Deutsche Bank AG", frozenset({"bank"}))


def test_parts_are_found_and_retyped(spark):
    from inkveil.operators.partial import propagate_parts

    p = spark.createDataFrame([("d", 1, "Deutsche Bank AG"), ("d", 2, "at deutsche\nbank today"), ("d", 3, "Deutsche said")], "doc_id string, page_number long, text string")
    r = regions(spark, [("d", 1, 0, 0, 16, "Deutsche Bank AG", "ORG", 0.9, "REGEX"), ("d", 3, 0, 0, 8, "Deutsche", "PERSON", 0.5, "NER")])
    got = {(x.page_number, x.text, x.pii_type, x.confidence) for x in propagate_parts(r, p).collect()}
    assert got == {(1, "Deutsche Bank AG", "ORG", 0.9), (2, "deutsche\nbank", "ORG", 0.765), (3, "Deutsche", "ORG", 0.765)}


def test_streams(spark, tmp_path):
    from inkveil.streaming.limiter import once_per_event, stream_detect, stream_limited

    rows = [(i % 4, 1, 1000.0 + i % 4) for i in range(8)]
    spark.createDataFrame(rows, "event_id long, user_id long, s double").selectExpr("event_id", "user_id", "timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS ts").write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{tmp_path}/events")
    for name, frame in (("once", once_per_event(events)), ("limited", stream_limited(events, 3, 60.0))):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 4
    assert spark.table("limited").where("allowed").count() == 3
    spark.createDataFrame(PAGES[:1], "doc_id string, page_number long, text string").write.parquet(f"{tmp_path}/pages")
    arriving = spark.readStream.schema("doc_id string, page_number long, text string").parquet(f"{tmp_path}/pages")
    stream_detect(arriving, f"{tmp_path}/out", f"{tmp_path}/c", spans.Config(language="en")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("pii_type = 'EMAIL'").count() == 1


def test_tokens_beyond_five_digits(spark, monkeypatch):
    monkeypatch.setattr(vault, "SPACE", 4)
    text = " ".join(f"u{i}@example.org" for i in range(10))
    p = spark.createDataFrame([("d", 1, text)], "doc_id string, page_number long, text string")
    r = detect.one_pattern(p, r"u[0-9]+@example\.org", "EMAIL").withColumn("action", F.lit("TOKENIZE"))
    minted = vault.mint_tokens(r)
    assert minted.select("token_string").distinct().count() == 10 and minted.where("token_string LIKE '[ANON_%'").count() == 6
    rows = vault.vault_rows(minted, p, F.current_timestamp())
    hidden = vault.redact(p, minted).select("doc_id", "page_number", "text")
    assert "example" not in hidden.first().text and vault.detokenize(hidden, rows).first().text == text
    again = vault.mint_tokens(r, rows)
    assert rows.unionByName(vault.vault_rows(again, p, F.current_timestamp())).select("token_string").distinct().count() == 20


def test_import_into_a_vault_that_holds_a_part(spark):
    p = spark.createDataFrame([("d", i, f"a{i}@example.org b{i}@example.org") for i in range(5)], "doc_id string, page_number long, text string")
    r = detect.one_pattern(p, r"[ab][0-9]+@example\.org", "EMAIL").withColumn("action", F.lit("TOKENIZE"))
    rows = vault.vault_rows(vault.mint_tokens(r), p, F.current_timestamp())
    held = rows.where("original_text LIKE 'a%'")
    fresh, counts = vault.import_tokens(held, rows)
    assert tuple(counts.first()) == (5, 5, 0) and not fresh.where("original_text LIKE 'a%'").count()


def test_import_query_meets_stored_tokens(spark, monkeypatch):
    seen, real = [], vault.import_tokens
    monkeypatch.setattr(vault, "import_tokens", lambda held, new: seen.append(held.join(new, "token_string", "left_semi").count()) or real(held, new))
    got = queries.vault_import_dedupe(spark, "/root/testdata/sf0.001").first()
    assert seen[-1] == got.skipped


def test_runs_change_no_verdict(spark, monkeypatch):
    import random
    from datetime import datetime, timedelta

    from inkveil.streaming import limiter

    monkeypatch.setattr(limiter, "STRETCH", 3)
    rng = random.Random(3)
    start, at, rows = datetime(2024, 1, 1), 0.0, []
    for i in range(400):
        at += rng.choice([0, 1, 2, 9, 10, 10.000001, 40])
        rows.append((i, rng.choice([1, 1, 1, 2, None]), start + timedelta(seconds=at)))
    rows += [(900, 1, None), (901, None, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(5)
    got = {r.event_id: r.allowed for r in limiter.rate_limited(df, 3, 10).collect()}
    rules = {k: limiter.Limiter(3, 10) for k in (1, 2, None)}
    expected = {i: t is not None and rules[k].allow(t.timestamp()) for i, k, t in rows}
    assert got == expected
    parted = limiter.runs(df.selectExpr("*", "unix_micros(ts) AS us"), "user_id", "us", 10)
    assert parted.count() == len(rows) and parted.select("user_id", "run").distinct().count() > 20
