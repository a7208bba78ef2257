"""Tokens that are never given twice, texts of which nothing found is left, and linked siblings that stay apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect, keys, layout, mutations, vault
from inkveil.sources import sinks
from inkveil.sources.ledger import TokenLedger

PAGES = "doc_id string, page_number long, text string"


def emails(spark, texts):
    p = spark.createDataFrame(texts, PAGES)
    return p, detect.one_pattern(p, r"[a-z0-9]+@example\.org", "EMAIL").withColumn("action", F.lit("TOKENIZE"))


def minted(df):
    return [r.token_string for r in df.select("token_string").collect()]


def test_mint_delete_import_mint_repeats_no_token(spark, tmp_path):
    book = TokenLedger(spark, f"file://{tmp_path}/ledger")
    p, r = emails(spark, [("d", i, f"a{i}@example.org b{i}@example.org") for i in range(4)])
    first = vault.mint_tokens(r, ledger=book)
    rows = vault.vault_rows(first, p, F.current_timestamp()).cache()
    seen = set(minted(rows))
    assert len(seen) == 8
    held = sinks.delete_tokens(rows, rows.where("original_text IN ('a1@example.org', 'b3@example.org')").select("token_id"))
    foreign = rows.limit(3).select(F.sha2("token_string", 224).alias("token_id"), F.element_at(F.array(*[F.lit(f"[E{(k * vault.STEP + vault.SHIFT) % vault.SPACE:05d}]") for k in (8, 9, 12)]), F.row_number().over(keys.Window.orderBy("token_string")).cast("int")).alias("token_string"), *rows.columns[2:])
    fresh, counts = vault.import_tokens(held, foreign)
    assert tuple(counts.first()) == (3, 0, 0)
    held = held.unionByName(fresh)
    second = minted(vault.mint_tokens(r, held, book))
    assert len(set(second)) == 8 and not set(second) & (seen | set(minted(held)))
    third = minted(vault.mint_tokens(r, held, TokenLedger(spark, f"file://{tmp_path}/ledger")))
    assert len(set(third)) == 8 and not set(third) & (seen | set(second) | set(minted(held)))


def test_two_writers_reserve_apart(spark, tmp_path):
    one, two = (TokenLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    asked = []

    def step(now):
        if not asked:  # another writer reserves between reading and writing
            asked.append(two.reserve(lambda c: {"E": (c.get("E", (0, 0))[0] + 5, 0)}))
        return {"E": (now.get("E", (0, 0))[0] + 3, 7), "P": (1, 0)}

    assert one.reserve(step) == {"E": (5, 0)} and asked == [{}]
    assert two.cursors(two.entries()[-1]) == {"E": (8, 7), "P": (1, 0)} and one.entries() == [1, 2]


def test_short_ranks_run_out_past_stored_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vault, "SPACE", 5)
    book = TokenLedger(spark, f"file://{tmp_path}/ledger")
    p, r = emails(spark, [("d", 1, " ".join(f"u{i}@example.org" for i in range(4)))])
    held = spark.createDataFrame([(f"[E{(1 * vault.STEP + vault.SHIFT) % 5:05d}]",), ("[ANON_E_00000000000A]",), ("[P00003]",)], "token_string string")
    first = minted(vault.mint_tokens(r, held, book))
    assert len(set(first)) == 4 and not set(first) & set(minted(held)) and not any("ANON" in t for t in first)
    second = minted(vault.mint_tokens(r, held, book))
    assert sorted(second) == [f"[ANON_E_{k:012X}]" for k in range(11, 15)]


def test_nothing_found_is_left_in_any_text(spark):
    texts = [("d", 1, "x a@example.org"), (None, 2, "y b@example.org"), (None, None, "z c@example.org"), ("e", None, "w d@example.org"), ("f", 3, None)]
    p, r = emails(spark, texts)
    for action in ("REMOVE", "TOKENIZE"):
        chosen = r.withColumn("action", F.lit(action))
        with_tokens = vault.mint_tokens(chosen) if action == "TOKENIZE" else chosen.withColumn("token_string", F.lit(None).cast("string"))
        hidden = vault.redact(p, with_tokens)
        assert with_tokens.count() == 4 and hidden.where("text LIKE '%@%'").count() == 0
        assert hidden.agg(F.sum("tokens_created"), F.sum("regions_removed")).first()[:] == ((4, 0) if action == "TOKENIZE" else (0, 4))
    rows = vault.vault_rows(with_tokens, p, F.current_timestamp())
    back = vault.detokenize(hidden.select("doc_id", "page_number", "text"), rows)
    assert {tuple(x) for x in back.select("doc_id", "page_number", "text").collect()} == set(texts)
    assert vault.redact(p, chosen.withColumn("token_string", F.lit(None).cast("string"))).where("text LIKE '%@%'").count() == 0


def test_numbers_in_a_hot_group(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 3, "a").otherwise("b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"))
    by = {}
    for r in keys.numbered(rows, "g", ["o"]).collect():
        by.setdefault(r.g, []).append((r.o, r.number))
    assert {k: len(v) for k, v in by.items()} == {None: 100, "a": 200, "b": 700}
    assert all([n for _, n in sorted(v)] == list(range(len(v))) for v in by.values())


@pytest.fixture(scope="module")
def placed(spark):
    lines = "123 Main Street,\nSpringfield, IL 62704\nUnited States\n\nEnd of the letter to a@example.org"
    pages = layout.with_grid(spark.createDataFrame([("d", 1, lines), ("d", 2, lines), ("e", 1, lines)], PAGES))
    r = layout.place(pages).withColumn("region_id", F.concat_ws("-", "doc_id", "page_number", "ord", "part")).withColumn("action", F.lit("PENDING"))
    return r.cache()


def test_siblings_are_of_one_page(spark, placed):
    groups = placed.where("linked_group IS NOT NULL").groupBy("linked_group").agg(F.count_distinct("doc_id", "page_number").alias("pages"), F.count("*").alias("n")).collect()
    assert groups and all(g.pages == 1 for g in groups) and any(g.n > 1 for g in groups)
    one = placed.where("doc_id = 'd' AND page_number = 1 AND linked_group IS NOT NULL").orderBy("part").first()
    chosen = spark.createDataFrame([(one.region_id, "REMOVE"), (one.region_id, "REMOVE"), ("none", "CANCEL")], "region_id string, action string")
    after = vault.set_action(placed, chosen)
    assert after.count() == placed.count()
    changed = {r.region_id for r in after.where("action = 'REMOVE'").collect()}
    siblings = {r.region_id for r in placed.where(F.col("linked_group") == one.linked_group).collect()}
    assert changed == siblings and len(siblings) > 1
    left = {r.region_id for r in mutations.delete(placed, chosen.select("region_id")).collect()}
    assert left == {r.region_id for r in placed.collect()} - siblings


def test_repeated_changes_and_null_types(spark, placed):
    some = placed.limit(1).select("region_id", F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(4.0).alias("y1"), F.lit("REMOVE").alias("action"))
    twice = some.unionByName(some.withColumn("x0", F.lit(2.0)))
    sizes = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 1, 600.0, 800.0)], "doc_id string, page_number long, width double, height double")
    assert mutations.move(placed, twice.drop("action"), sizes).count() == mutations.sync(placed, twice).count() == placed.count()
    untyped = placed.withColumn("pii_type", F.lit(None).cast("string"))
    assert mutations.without_types(untyped, ["EMAIL"]).count() == placed.count()
