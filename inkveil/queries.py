"""Driver queries of the personal-data engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil import queries_geometry, queries_records
from inkveil.functions import language, text, validators
from inkveil.lexicon.patterns import STANDALONE
from inkveil.lexicon.words import BIC_COUNTRIES, STOP_WORDS, TOKEN_LETTERS, WORD_EDGES
from inkveil.operators import analytics, detect, document, layout, partial, search, vault
from inkveil.operators.store import shared_folder, stored
from inkveil.plans import documents
from inkveil.sources import ledger
from inkveil.sources.tables import document_pages, load, strip_tags, web_pages
from inkveil.streaming.limiter import rate_limited, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Patterns that both engines read alike.
SIMPLE = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IP_ADDRESS": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "PHONE": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "PHONE_INTL": r"\+[0-9]{1,3}[ -][0-9()]{2,5}[ -][0-9]{2,4}[ -][0-9]{2,4}",
}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _spans_sql(kind: str, rows: str = "SELECT source AS doc_id, doc_id AS page_number, coalesce(text, '') AS text FROM documents") -> str:
    p = SIMPLE[kind].replace("'", "''")
    return f"""(WITH p AS ({rows}),
    f AS (SELECT *, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM p WHERE regexp_matches(text, '{p}')),
    i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f),
    s AS (SELECT doc_id, page_number, CAST(k - 1 AS INTEGER) AS ord, m[k] AS text,
      CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM i)
    SELECT doc_id, page_number, ord, start, CAST(start + length(text) AS INTEGER) AS "end", text, '{kind}' AS pii_type FROM s)"""


def _spans(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.one_pattern(document_pages(load(spark, sf_dir, "documents")), SIMPLE[kind], kind)

    return run


for _name, _kind in (("email_spans", "EMAIL"), ("ipv4_spans", "IP_ADDRESS"), ("phone_paren_spans", "PHONE"), ("phone_intl_spans", "PHONE_INTL")):
    QUERIES[_name] = _spans(_kind)
    ORACLES[_name] = f"SELECT * FROM {_spans_sql(_kind)}"


def simple_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the simple patterns with an action that follows from the page number."""
    pages = document_pages(load(spark, sf_dir, "documents"))
    out = None
    for kind in ("EMAIL", "IP_ADDRESS", "PHONE"):
        one = detect.one_pattern(pages, SIMPLE[kind], kind)
        out = one if out is None else out.unionByName(one)
    action = F.when(F.col("page_number") % 3 == 0, "REMOVE").when(F.col("page_number") % 3 == 1, "TOKENIZE").otherwise("PENDING")
    return out.withColumn("action", F.when(F.substring("doc_id", 4, 2).cast("int") % 2 == 0, F.when(action == "PENDING", "CANCEL").otherwise(action)).otherwise(action))


REGIONS_SQL = "(SELECT *, CASE WHEN page_number % 3 = 0 THEN 'REMOVE' WHEN page_number % 3 = 1 THEN 'TOKENIZE' WHEN CAST(substr(doc_id, 4, 2) AS INTEGER) % 2 = 0 THEN 'CANCEL' ELSE 'PENDING' END AS action FROM (" + " UNION ALL ".join(f"SELECT * FROM {_spans_sql(k)}" for k in ("EMAIL", "IP_ADDRESS", "PHONE")) + "))"

_STOPS = ", ".join(f"('{code}', {i}, '{w}')" for i, (code, stops) in enumerate(STOP_WORDS.items()) for w in sorted(set(stops.split())))
_EDGES = WORD_EDGES.replace("'", "''")
LANG_SQL = f"""(WITH stop(lang, ord, w) AS (VALUES {_STOPS}),
  w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(substr(text, 1, 2000), '\\s+', ' ', 'g')), ' ')) AS w FROM documents),
  f AS (SELECT doc_id, trim(lower(w), '{_EDGES}') AS w FROM w WHERE length(trim(lower(w), '{_EDGES}')) >= 2),
  n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
  h AS (SELECT f.doc_id, stop.lang, stop.ord, count(*) AS hits FROM f JOIN stop ON f.w = stop.w GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) AS r FROM h)
  SELECT d.doc_id, d.lang, CASE WHEN coalesce(n.n, 0) < 20 OR b.hits IS NULL OR b.hits * 1.0 / n.n < 0.1 THEN 'en' ELSE b.lang END AS detected
  FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN b ON d.doc_id = b.doc_id AND b.r = 1)"""


@query(f"SELECT doc_id, detected FROM {LANG_SQL}")
def lang_detect(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", language.language(F.coalesce("text", F.lit(""))).alias("detected"))


@query(f"SELECT lang, detected, count(*) AS n FROM {LANG_SQL} GROUP BY 1, 2")
def lang_confusion(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("lang", language.language(F.coalesce("text", F.lit(""))).alias("detected")).groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(trim(text)) >= 30 AS scanned FROM documents")
def page_gate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim("text")) >= 30).alias("scanned"))


@query(f"SELECT pii_type, d.lang, count(*) AS n FROM {REGIONS_SQL} r JOIN documents d ON r.page_number = d.doc_id GROUP BY 1, 2")
def span_counts_by_type_lang(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_number"), "lang")
    return simple_regions(spark, sf_dir).join(d, "page_number").groupBy("pii_type", "lang").agg(F.count("*").alias("n"))


_LABEL = r"(?i)(^|[^A-Za-z0-9])(phone|tel|mobile|cell|fax|call|contact|number)($|[^A-Za-z0-9])"


@query(f"""SELECT s.page_number, s.ord, CASE WHEN regexp_matches(substr(d.text, greatest(1, start - 99), least(start, 100)), '{_LABEL}')
  OR regexp_matches(substr(d.text, "end" + 1, 100), '{_LABEL}') THEN CAST(0.25 AS DOUBLE) ELSE CAST(-0.15 AS DOUBLE) END AS boost
  FROM {_spans_sql("PHONE")} s JOIN documents d ON s.page_number = d.doc_id""")
def context_boost_phone(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_number"), F.col("text").alias("t"))
    s = _spans("PHONE")(spark, sf_dir).join(d, "page_number")
    before = F.substring(F.col("t"), F.greatest(F.lit(1), F.col("start") - 99), F.least(F.col("start"), F.lit(100)))
    after = F.substring(F.col("t"), F.col("end") + 1, F.lit(100))
    return s.select("page_number", "ord", F.when(before.rlike(_LABEL) | after.rlike(_LABEL), 0.25).otherwise(-0.15).alias("boost"))


# Validators, over numbers made from keys.

_D = lambda i: f"CAST(substr(d, {i}, 1) AS INTEGER)"
_W = lambda ws: " + ".join(f"{_D(i)} * ({w})" for i, w in enumerate(ws, 1))
_TWICE = lambda i: f"(CASE WHEN {_D(i)} * 2 > 9 THEN {_D(i)} * 2 - 9 ELSE {_D(i)} * 2 END)"
_NIF = f"(({_W([9, 8, 7, 6, 5, 4, 3, 2])}) % 11)"
_NHS = f"(11 - ({_W([10, 9, 8, 7, 6, 5, 4, 3, 2])}) % 11)"
_BSN = f"({_W([9, 8, 7, 6, 5, 4, 3, 2, -1])})"
_NISS = f"((10 - ({_W([29, 23, 19, 17, 13, 11, 7, 5, 3, 2])}) % 10) % 10)"
_CHECKS = {
    "luhn_check": (16, 1_000_003_919, validators.luhn, "(" + " + ".join(_TWICE(i) if i % 2 else _D(i) for i in range(1, 17)) + ") % 10 = 0"),
    "bsn_check": (9, 48_611, validators.bsn, f"{_BSN} % 11 = 0 AND {_BSN} <> 0"),
    "nif_check": (9, 48_611, validators.nif, f"substr(d, 1, 1) IN ('1', '2', '3', '5', '6', '7', '8', '9') AND {_D(9)} = CASE WHEN {_NIF} < 2 THEN 0 ELSE 11 - {_NIF} END"),
    "nhs_check": (10, 611_953, validators.nhs, f"{_NHS} <> 10 AND {_D(10)} = CASE WHEN {_NHS} = 11 THEN 0 ELSE {_NHS} END"),
    "piva_check": (11, 6_119_531, validators.piva, "(" + " + ".join(_D(i) if i % 2 else _TWICE(i) for i in range(1, 12)) + ") % 10 = 0"),
    "niss_check": (11, 6_119_531, validators.niss, f"{_D(11)} = {_NISS} AND d <> repeat(substr(d, 1, 1), 11)"),
}


def _check(width: int, step: int, rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = load(spark, sf_dir, "orders")
        number = F.lpad((F.col("o_orderkey") * step % 10**width).cast("string"), width, "0")
        return o.select("o_orderkey", number.alias("d")).select("o_orderkey", rule(F.col("d")).alias("valid"))

    return run


for _name, (_width, _step, _rule, _sql) in _CHECKS.items():
    QUERIES[_name] = _check(_width, _step, _rule)
    ORACLES[_name] = f"SELECT o_orderkey, {_sql} AS valid FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * {_step} % {10**_width} AS VARCHAR), {_width}, '0') AS d FROM orders)"

#: A German number: eighteen digits; D is 13 and E is 14, and the check digits follow them at the end.
_IBAN = "CAST(CAST(substr(d, 3) AS HUGEINT) * 1000000 + 131400 + CAST(substr(d, 1, 2) AS HUGEINT) AS HUGEINT) % 97 = 1"


@query(f"SELECT c_custkey, {_IBAN} AS valid FROM (SELECT c_custkey, lpad(CAST(c_custkey * 97 % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '0') AS d FROM customer)")
def iban_mod97(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    number = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") * 97 % 100).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 18, "0"))
    return c.select("c_custkey", validators.iban(number).alias("valid"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS a, l_suppkey % 20 AS b, 1990 + l_linenumber AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a > 31 THEN b BETWEEN 1 AND 12 AND c BETWEEN 1 AND 31 WHEN a > 12 THEN b BETWEEN 1 AND 12 AND a BETWEEN 1 AND 31 ELSE a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 31 END AS valid FROM p""")
def valid_date(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    date = F.concat_ws("/", F.col("l_partkey") % 40, F.col("l_suppkey") % 20, F.col("l_linenumber") + 1990)
    return li.select("l_orderkey", "l_linenumber", validators.plausible_date(date).alias("valid"))


_LETTERS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 + 1 AS INTEGER), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey * 7 % 26 + 1 AS INTEGER), 1)"


@query(f"SELECT c_custkey, ({_LETTERS}) IN ({', '.join(map(repr, BIC_COUNTRIES))}) AS valid FROM customer")
def bic_check(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'BANK' || {_LETTERS} || '2X'").alias("b")).select("c_custkey", validators.bic(F.col("b")).alias("valid"))


# Text functions.


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents")
def ws_collapse(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.ws_collapse(F.col("text")).alias("t"))


@query("SELECT doc_id, translate(text, '\"''‘’‚‛“”„‟«»‹›', '') AS t FROM documents")
def strip_quotes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.strip_quotes(F.col("text")).alias("t"))


@query(f"""SELECT s.page_number, s.pii_type, s.ord, (CASE WHEN start > 50 THEN '...' ELSE '' END) || substr(d.text, greatest(0, start - 50) + 1, least(length(d.text), "end" + 50) - greatest(0, start - 50))
  || (CASE WHEN "end" + 50 < length(d.text) THEN '...' ELSE '' END) AS snippet FROM {REGIONS_SQL} s JOIN documents d ON s.page_number = d.doc_id""")
def context_snippet(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_number"), F.col("text").alias("t"))
    s = simple_regions(spark, sf_dir).join(d, "page_number")
    return s.select("page_number", "pii_type", "ord", text.context_snippet(F.col("t"), F.col("start"), F.col("end")).alias("snippet"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')) > 0 AS has_text FROM pages")
def strip_web_tags(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", (F.length(strip_tags(F.col("html"))) > 0).alias("has_text"))


@query("SELECT c_custkey, regexp_matches(lower(c_name), '\\b(inc|corp|ltd|co|company)\\b') AS legal FROM customer")
def legal_suffix(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", document.legal_suffix(F.col("c_name")).alias("legal"))


# The catalog.

#: Patterns of the catalog that both engines read alike: numbered, without look-around.
SHARED = {k: (kind, pattern) for k, (kind, _, _, flag, pattern) in enumerate(STANDALONE) if not flag and kind in ("EMAIL", "SSN", "PHONE", "CREDIT_CARD", "IBAN", "DATE", "IP_ADDRESS", "DRIVER_LICENSE") and "(?!" not in pattern and "(?<" not in pattern}


def _matches_sql(k: int, kind: str, pattern: str) -> str:
    return f"SELECT doc_id, {k} AS pattern, '{kind}' AS pii_type, CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{pattern}')"


@query(" UNION ALL ".join(_matches_sql(k, *p) for k, p in SHARED.items()))
def catalog_matches(spark, sf_dir):
    """How often each pattern of the catalog matches in each document, by the detector's own filter and patterns."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return detect.count_matches(docs, {k: p for k, (_, p) in SHARED.items()}).select("doc_id", "pattern", F.element_at(F.create_map(*[F.lit(x) for k, (kind, _) in SHARED.items() for x in (k, kind)]), F.col("pattern")).alias("pii_type"), "n")


# Detection and what follows it.


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(document_pages(load(spark, sf_dir, "documents")))


@query()
def pii_detect_regions(spark, sf_dir):
    return detected(spark, sf_dir)


@query()
def pii_detect_web(spark, sf_dir):
    return detect.detect(web_pages(load(spark, sf_dir, "pages")))


@query()
def regex_sweep(spark, sf_dir):
    return detect.pattern_spans(document_pages(load(spark, sf_dir, "documents")))


@query()
def propagate_exact(spark, sf_dir):
    pages = document_pages(load(spark, sf_dir, "documents"))
    return document.propagate(stored(detect.detect(pages)), pages)


SIMPLE["ORG"] = r"[A-Z][a-z]+ [A-Z][a-z]+"


@query(f"""WITH held AS MATERIALIZED (SELECT * FROM {_spans_sql("ORG")} WHERE page_number % 2 = 0),
  v AS (SELECT doc_id, lower(text) AS key, replace(lower(text), ' ', '\\s+') AS pattern, min(page_number * 1000000 + ord) AS turn FROM held GROUP BY 1, 2, 3),
  p AS (SELECT source AS doc_id, doc_id AS page_number, text, strip_accents(lower(text)) AS low FROM documents WHERE text IS NOT NULL),
  m AS (SELECT p.*, v.turn, regexp_extract_all(low, v.pattern) AS m, string_split_regex(low, v.pattern) AS g FROM p JOIN v ON p.doc_id = v.doc_id AND regexp_matches(low, v.pattern)),
  k AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
  s AS (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, CAST(length(m[i]) AS INTEGER) AS n FROM k),
  f AS (SELECT doc_id, page_number, turn, start, start + n AS "end", substr(text, start + 1, n) AS text FROM s
    WHERE NOT regexp_matches(substr(low, start, least(start, 1)), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(low, start + n + 1, 1), '[\\p{{L}}\\p{{N}}_]'))
  SELECT doc_id, page_number, 'ORG' AS pii_type, start, "end", text FROM f
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.page_number = f.page_number AND least(f."end", h."end") - greatest(f.start, h.start) >= 0.5 * (f."end" - f.start))
  AND NOT EXISTS (SELECT 1 FROM f e WHERE e.page_number = f.page_number AND e.turn < f.turn AND least(f."end", e."end") - greatest(f.start, e.start) >= 0.5 * (f."end" - f.start))""")
def propagate_values(spark, sf_dir):
    """Names found on even pages, on all pages of their documents."""
    pages = document_pages(load(spark, sf_dir, "documents"))
    held = detect.one_pattern(pages, SIMPLE["ORG"], "ORG").where("page_number % 2 = 0").withColumn("confidence", F.lit(0.9)).withColumn("source", F.lit("REGEX"))
    found = document.occurrences(document.templates(held), held, pages, 1_000_000, in_words=True)
    return found.select("doc_id", "page_number", "pii_type", "start", "end", "text")


@query()
def document_regions(spark, sf_dir):
    return documents.document_regions(document_pages(load(spark, sf_dir, "documents")))


_UNIFIED = "(SELECT *, first_value(pii_type) OVER (PARTITION BY lower(text) ORDER BY confidence DESC, page_number, ord, pii_type) AS winner FROM (SELECT *, CAST(length(text) % 7 AS DOUBLE) / 10 + CASE WHEN pii_type = 'PHONE' THEN 0.1 ELSE 0 END AS confidence FROM " + REGIONS_SQL + "))"


@query(f"SELECT page_number, ord, text, winner AS pii_type FROM {_UNIFIED}")
def unify_types(spark, sf_dir):
    r = simple_regions(spark, sf_dir).drop("action").withColumn("doc_id", F.lit("all"))
    score = F.length("text") % 7 / 10 + F.when(F.col("pii_type") == "PHONE", 0.1).otherwise(0.0)
    r = r.withColumn("confidence", score).withColumn("source", F.lit("REGEX"))
    return document.unify_types(r).select("page_number", "ord", "text", "pii_type")


_NESTED = "(SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS ord, CAST(l_partkey % 50 AS INTEGER) AS start, CAST(l_partkey % 50 + l_quantity AS INTEGER) AS \"end\", l_discount AS confidence, l_returnflag AS pii_type FROM lineitem)"


@query(f"""SELECT a.doc_id, a.ord FROM {_NESTED} a WHERE NOT EXISTS (SELECT 1 FROM {_NESTED} b WHERE a.doc_id = b.doc_id AND a.pii_type = b.pii_type AND b.start <= a.start AND b."end" >= a."end" AND b.confidence >= a.confidence
  AND ((b."end" - b.start) > (a."end" - a.start) OR ((b."end" - b.start) = (a."end" - a.start) AND b.ord < a.ord)))""")
def containment_dedupe(spark, sf_dir):
    r = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").cast("int").alias("ord"), (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("int").alias("end"), F.lit("").alias("text"), F.col("l_returnflag").alias("pii_type"), F.col("l_discount").alias("confidence"), F.lit("").alias("source"))
    return document.drop_contained(r).select("doc_id", "ord")


# Actions, redaction, vault.


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = document_pages(load(spark, sf_dir, "documents"))
    regions = simple_regions(spark, sf_dir)
    minted = vault.mint_tokens(regions)
    rows = vault.vault_rows(minted, pages, F.timestamp_micros(F.col("page_number") * 1_000_000))
    return pages, regions.where("action <> 'TOKENIZE'").withColumn("token_string", F.lit(None).cast("string")).unionByName(minted), rows


@query("SELECT source AS doc_id, doc_id AS page_number, regexp_replace(coalesce(text, ''), '" + SIMPLE["EMAIL"] + "', '---', 'g') AS text FROM documents")
def redact_remove(spark, sf_dir):
    pages = document_pages(load(spark, sf_dir, "documents"))
    r = detect.one_pattern(pages, SIMPLE["EMAIL"], "EMAIL").withColumn("action", F.lit("REMOVE")).withColumn("token_string", F.lit(None).cast("string"))
    return vault.redact(pages, r).select("doc_id", "page_number", "text")


@query("SELECT doc_id AS page_number, regexp_replace(coalesce(text, ''), '" + SIMPLE["EMAIL"] + "', '---', 'g') AS text FROM documents")
def redact_without_ids(spark, sf_dir):
    """Pages of which every third lacks its document are redacted as the others are."""
    pages = document_pages(load(spark, sf_dir, "documents")).withColumn("doc_id", F.when(F.col("page_number") % 3 != 0, F.col("doc_id")))
    r = detect.one_pattern(pages, SIMPLE["EMAIL"], "EMAIL").withColumn("action", F.lit("REMOVE")).withColumn("token_string", F.lit(None).cast("string"))
    return vault.redact(pages, r).select("page_number", "text")


_LETTER = "CASE pii_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOKEN_LETTERS.items()) + " ELSE 'U' END"


@query(f"""WITH r AS (SELECT *, {_LETTER} AS letter FROM {REGIONS_SQL} WHERE action = 'TOKENIZE'), n AS (SELECT *, row_number() OVER (PARTITION BY letter ORDER BY doc_id, page_number, start, "end", ord) - 1 AS rank FROM r)
SELECT page_number, pii_type, ord, CASE WHEN rank < {vault.SPACE} THEN '[' || letter || lpad(CAST((rank * {vault.STEP} + {vault.SHIFT}) % {vault.SPACE} AS VARCHAR), 5, '0') || ']' ELSE '[ANON_' || letter || '_' || lpad(hex(rank - {vault.SPACE}), 12, '0') || ']' END AS token_string FROM n""")
def minted_tokens(spark, sf_dir):
    return vault.mint_tokens(simple_regions(spark, sf_dir)).select("page_number", "pii_type", "ord", "token_string")


_NUMBER = f"CASE WHEN rank < {vault.SPACE} THEN '[' || letter || lpad(CAST((rank * {vault.STEP} + {vault.SHIFT}) % {vault.SPACE} AS VARCHAR), 5, '0') || ']' ELSE '[ANON_' || letter || '_' || lpad(hex(rank - {vault.SPACE}), 12, '0') || ']' END"


@query(f"""WITH t AS (SELECT *, {_LETTER} AS letter FROM {REGIONS_SQL} WHERE action IN ('REMOVE', 'TOKENIZE')),
  n AS (SELECT *, row_number() OVER (PARTITION BY letter, action ORDER BY doc_id, page_number, start, "end", ord) - 1 AS rank FROM t),
  b AS (SELECT doc_id, page_number, start, "end", action, CASE WHEN action = 'REMOVE' THEN '---' ELSE {_NUMBER} END AS put FROM n),
  o AS (SELECT *, coalesce(max("end") OVER (PARTITION BY page_number ORDER BY start, "end", put ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM b),
  k AS (SELECT o.*, d.text AS page FROM o JOIN documents d ON d.doc_id = o.page_number WHERE start >= prior),
  s AS (SELECT page_number, string_agg(substr(page, prior + 1, start - prior) || put, '' ORDER BY start) AS done, max("end") AS last, count(*) FILTER (WHERE action = 'TOKENIZE') AS tokens, count(*) FILTER (WHERE action = 'REMOVE') AS removed FROM k GROUP BY 1)
  SELECT d.source AS doc_id, d.doc_id AS page_number, coalesce(s.done || substr(d.text, s.last + 1), d.text, '') AS text, CAST(coalesce(s.tokens, 0) AS INTEGER) AS tokens_created, CAST(coalesce(s.removed, 0) AS INTEGER) AS regions_removed
  FROM documents d LEFT JOIN s ON s.page_number = d.doc_id""")
def tokenize(spark, sf_dir):
    pages, regions, _ = _tokens(spark, sf_dir)
    return vault.redact(pages, regions)


@query(f"""WITH r AS (SELECT *, {_LETTER} AS letter FROM {REGIONS_SQL} WHERE action = 'TOKENIZE'),
  n AS (SELECT letter, count(*) FILTER (WHERE page_number % 2 = 0) AS n FROM r GROUP BY 1),
  m AS (SELECT r.*, n.n, row_number() OVER (PARTITION BY letter ORDER BY doc_id, page_number, start, "end", ord) - 1 AS j FROM r JOIN n USING (letter) WHERE page_number % 2 = 1)
SELECT page_number, pii_type, ord, {_NUMBER} AS token_string FROM (SELECT *, n + j + CASE WHEN j > 0 THEN 1 ELSE 0 END AS rank FROM m)""")
def ledger_tokens(spark, sf_dir):
    """Tokens of odd pages after those of even pages were minted and deleted, and a vault was imported that holds the
    second number that was free for each letter."""
    book = ledger.TokenLedger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    regions = simple_regions(spark, sf_dir)
    first = stored(vault.mint_tokens(regions.where("page_number % 2 = 0"), ledger=book))
    imported = first.groupBy(vault.token_letter(F.col("pii_type")).alias("letter")).agg((F.count("*") + 1).alias("rank"))
    imported = imported.select(F.concat(F.lit("["), "letter", F.lpad(F.pmod(F.col("rank") * vault.STEP + vault.SHIFT, F.lit(vault.SPACE)).cast("string"), 5, "0"), F.lit("]")).alias("token_string"))
    return vault.mint_tokens(regions.where("page_number % 2 = 1"), imported, book).select("page_number", "pii_type", "ord", "token_string")


@query("SELECT source AS doc_id, doc_id AS page_number, coalesce(text, '') AS text FROM documents")
def detokenize_roundtrip(spark, sf_dir):
    pages, regions, rows = _tokens(spark, sf_dir)
    hidden = vault.redact(pages, regions.where("action = 'TOKENIZE'"))
    return vault.detokenize(hidden.select("doc_id", "page_number", "text"), rows).select("doc_id", "page_number", "text")


@query(f"SELECT count(*) AS total_tokens, count(DISTINCT doc_id) AS total_documents FROM {REGIONS_SQL} WHERE action = 'TOKENIZE'")
def vault_stats(spark, sf_dir):
    rows = _tokens(spark, sf_dir)[2]
    return rows.agg(F.countDistinct("token_string").alias("total_tokens"), F.countDistinct("source_document").alias("total_documents"))


@query(f"SELECT page_number, text AS original_text FROM {REGIONS_SQL} WHERE action = 'TOKENIZE' ORDER BY page_number DESC, text LIMIT 10 OFFSET 10")
def vault_list_page(spark, sf_dir):
    rows = _tokens(spark, sf_dir)[2].select((F.unix_micros("created_at") / 1_000_000).cast("long").alias("page_number"), "original_text")
    return analytics.page_of(rows, 2, 10, F.desc("page_number"), "original_text")


@query(f"SELECT count(*) FILTER (WHERE page_number % 2 = 1) AS imported, count(*) FILTER (WHERE page_number % 2 = 0) AS skipped, CAST(0 AS BIGINT) AS errors FROM {REGIONS_SQL} WHERE action = 'TOKENIZE'")
def vault_import_dedupe(spark, sf_dir):
    """All tokens are offered to a vault that holds those of the even pages."""
    rows = _tokens(spark, sf_dir)[2]
    return vault.import_tokens(rows.where(F.unix_micros("created_at") / 1_000_000 % 2 == 0), rows)[1]


# Listings, audits, accounts.


@query(f"SELECT doc_id, count(*) AS regions_count, sum(CASE WHEN action = 'PENDING' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN action IN ('REMOVE', 'TOKENIZE') THEN 1 ELSE 0 END) > 0 AS is_protected FROM {REGIONS_SQL} GROUP BY doc_id")
def docs_protected(spark, sf_dir):
    return analytics.protected_documents(simple_regions(spark, sf_dir))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a.lower()}" for a in ("PENDING", "REMOVE", "TOKENIZE", "CANCEL")) + f" FROM {REGIONS_SQL}")
def regions_status_counts(spark, sf_dir):
    return analytics.status_counts(simple_regions(spark, sf_dir))


@query(f"SELECT pii_type, count(*) AS n FROM {REGIONS_SQL} GROUP BY 1")
def audit_type_breakdown(spark, sf_dir):
    return analytics.counts_by_type(simple_regions(spark, sf_dir))


@query(f"SELECT pii_type, text, n, CAST(rank AS INTEGER) AS rank FROM (SELECT pii_type, text, n, row_number() OVER (PARTITION BY pii_type ORDER BY n DESC, text) AS rank FROM (SELECT pii_type, text, count(*) AS n FROM {REGIONS_SQL} GROUP BY 1, 2)) WHERE rank <= 20")
def audit_topk_texts(spark, sf_dir):
    return analytics.top_texts(simple_regions(spark, sf_dir), 20)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def docs_paged(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return analytics.page_of(o, 3, 50, F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE lower(p_name) LIKE '%1%'")
def file_sort_search(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.where(F.lower("p_name").contains("1")).orderBy(F.lower("p_name").asc(), "p_partkey").select("p_partkey", "p_name", "p_size")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1")
def latest_active(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return analytics.latest(o, "o_custkey", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS machines, count(o_orderkey) < 3 * (1 + c_nationkey % 3) AS may_activate FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey")
def seat_limit(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    used = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("machines"))
    n = F.coalesce("machines", F.lit(0))
    return c.join(used, "c_custkey", "left").select("c_custkey", n.alias("machines"), (n < 3 * (1 + F.col("c_nationkey") % 3)).alias("may_activate"))


@query("SELECT count(*) AS users, count(*) FILTER (WHERE c_acctbal > 0) AS active, (SELECT count(*) FROM orders) AS subscriptions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_subscriptions FROM customer")
def admin_stats(spark, sf_dir):
    c = load(spark, sf_dir, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    o = load(spark, sf_dir, "orders").agg(F.count("*").alias("subscriptions"), F.count_if(F.col("o_orderstatus") == "O").alias("open_subscriptions"))
    return c.crossJoin(o)  # one row each


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS hits FROM events")
def rate_window_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id", "run").orderBy("us").rangeBetween(-60_000_000, 0)
    return runs(e, "user_id", "us", 60.0).select("event_id", F.count("*").over(w).alias("hits"))


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
  s AS (SELECT event_id, user_id, k, true AS allowed, [us] AS hits FROM e WHERE k = 1 UNION ALL
    SELECT event_id, user_id, k, len(held) < 3 AS allowed, CASE WHEN len(held) < 3 THEN list_append(held, us) ELSE held END AS hits FROM
      (SELECT e.event_id, e.user_id, e.k, e.us, list_filter(s.hits, lambda h: h >= e.us - 60000000) AS held FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
  SELECT event_id, user_id, allowed FROM s"""


@query(_LIMITED)
def rate_limit_hits(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rate_limited(e, 3, 60.0).select("event_id", "user_id", "allowed")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def blacklist_exact(spark, sf_dir):
    """The passages of the benchmark stand for a user's list of terms."""
    terms = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    found = search.containing_terms(load(spark, sf_dir, "documents"), terms)
    return found.select(F.col("term_id").alias("item_id"), F.col("row_id").alias("doc_id"))


@query()
def partial_org(spark, sf_dir):
    pages = document_pages(load(spark, sf_dir, "documents"))
    return partial.propagate_parts(stored(detect.detect(pages)), pages)


@query()
def layout_regions(spark, sf_dir):
    """Boxes of all spans, on a synthetic grid of words."""
    return layout.place(layout.with_grid(web_pages(load(spark, sf_dir, "pages"))))


@query()
def blacklist_fuzzy(spark, sf_dir):
    """All benchmark passages, whole, searched with a tolerance for spelling."""
    terms = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    return search.search_terms(document_pages(load(spark, sf_dir, "documents")), terms, 0.9)


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def page_sizes(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT DISTINCT lower(text) AS key FROM " + REGIONS_SQL)
def distinct_values(spark, sf_dir):
    return simple_regions(spark, sf_dir).select(document.value_key(F.col("text")).alias("key")).distinct()


for _module in (queries_records, queries_geometry):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
