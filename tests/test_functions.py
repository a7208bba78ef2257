from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.functions import language, text, validators


@given(st.text(max_size=60))
def test_accent_stripping_keeps_offsets(s):
    assert len(text.strip_accents_py(s)) == len(s)


def test_accents_and_matching_form():
    assert text.strip_accents_py("éüñßæœ한") == "eunsao한"
    assert text.matching_form("L’Esprit  —  ÉTÉ\n") == "l'esprit - ete"


@pytest.mark.parametrize(("key", "hit", "miss"), [("acme inc.", "at Acme\nInc. now", "acme incorporated"), ("jean dupont", "JEAN  DUPONT", "jean dupontel")])
def test_flex_pattern(key, hit, miss):
    assert text.flex_pattern(key).search(hit) and not text.flex_pattern(key).search(miss)


CASES = [
    (validators.luhn, validators.luhn_ok, ["4111 1111 1111 1111", "4111 1111 1111 1112", "378282246310005", "411111"]),
    (validators.iban, validators.iban_ok, ["DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "FR1420041010050500013M02606", "XX"]),
    (validators.plausible_date, validators.date_ok, ["31/12/2024", "12/31/2024", "2024-13-01", "2024-12-31", "40/40/2024", "1/2", "0/1/2020"]),
    (validators.bsn, lambda d: len(d) == 9 and validators.bsn_ok(d), ["111222333", "123456782", "123456789", "12"]),
    (validators.nhs, lambda d: len(d) == 10 and validators.nhs_ok(d), ["9434765919", "9434765918"]),
    (validators.piva, lambda d: validators.piva_ok(d), ["12345670017", "12345670018"]),
    (validators.niss, lambda d: validators.niss_ok(d), ["11111111111", "12345678901"]),
]


@pytest.mark.parametrize(("column", "plain", "values"), CASES)
def test_validators_agree(spark, column, plain, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", column(F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in rows} == {v: bool(plain(v)) for v in values}


def test_language_column_equals_kernel(spark):
    texts = ["the cat and the dog are in the house with all of them and they know it is not so big for you", "le chat et le chien sont dans la maison avec les autres et il est pas plus grand que nous", "short text", "", "der Hund und die Katze sind in dem Haus mit den anderen und es ist nicht so gross wie das alte von uns"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", language.language(F.col("t")).alias("l")).collect()
    assert [r.l for r in sorted(rows)] == [language.language_py(t) for t in texts] == ["en", "fr", "en", "en", "de"]


def test_snippet_and_collapse(spark):
    row = spark.createDataFrame([("x" * 60 + "NAME" + "y" * 60,)], "t string").select(text.context_snippet(F.col("t"), F.lit(60), F.lit(64)).alias("s"), text.ws_collapse(F.lit(" a \n b ")).alias("w")).first()
    assert row.s == "..." + "x" * 50 + "NAME" + "y" * 50 + "..." and row.w == "a b"


def test_accents_fall_alike_in_columns_and_in_python(spark):
    every = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    assert {c for c in every if text.strip_accents_py(c) != c} == set(text.accented()[0])
    rows = ["Ünïcödé ÆŒßþ", "한국어 Ελληνικά ὠδή", "\U0002F80F a\u0301", "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", text.strip_accents("t").alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: None if t is None else text.strip_accents_py(t) for k, t in enumerate(rows)}
