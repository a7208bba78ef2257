"""Queries with SQL, against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from inkveil import queries_records

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["email_spans", "lang_detect", "context_boost_phone", "luhn_check", "nif_check", "iban_mod97", "valid_date", "context_snippet", "unify_types", "containment_dedupe", "redact_remove", "detokenize_roundtrip", "vault_stats", "docs_protected", "audit_topk_texts", "latest_active", "rate_window_counts", "blacklist_exact", "vault_import_dedupe", *queries_records.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = duck.sql(entry.oracle_sql()[name])
    names = list(found.columns)
    theirs = sorted(repr(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in cols)) for row in found.fetchall())
    assert sorted(names) == cols and ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
