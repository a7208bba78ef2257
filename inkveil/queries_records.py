"""Queries over accounts and over edits of regions, and their SQL. Orders, customers and events stand for the records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import validators
from inkveil.lexicon.words import CONTEXT, PHONE_LABELS
from inkveil.operators import accounts, detect, document, mutations, spans, splitting, structured
from inkveil.sources import export, sinks
from inkveil.sources.tables import document_pages, load, web_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '1999-06-01 12:00:00'"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Both engines read these alike.
_SUBSCRIPTIONS = """SELECT o_orderkey AS subscription_id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'free_trial' ELSE 'pro' END AS plan,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'trialing' ELSE 'canceled' END AS status, CAST(1 + o_orderkey % 2 AS INTEGER) AS seats, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 400 DAY END AS current_period_end, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 200 DAY END AS trial_end FROM orders"""
_MACHINES = "SELECT o_orderkey AS machine_id, (o_orderkey * 7) % 3000 AS user_id, concat('m', CAST(o_orderkey % 5000 AS VARCHAR(9))) AS fingerprint, o_orderpriority < '4' AS is_active FROM orders"
_KEYS = "SELECT o_orderkey AS key_id, (o_orderkey * 7) % 3000 AS user_id, concat('m', CAST(o_orderkey % 5000 AS VARCHAR(9))) AS fingerprint, o_orderdate AS issued_at, o_orderdate + INTERVAL 365 DAY AS expires_at, o_orderstatus = 'F' AS revoked FROM orders"
_REQUESTS = "SELECT c_custkey AS user_id, concat('m', CAST(CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 2143) % 3000 ELSE c_custkey END AS VARCHAR(9))) AS fingerprint FROM customer"
_TRIALS = "SELECT concat('m', CAST(o_orderkey % 5000 AS VARCHAR(9))) AS fingerprint FROM orders WHERE o_orderkey % 10 = 0"
_REGIONS = """SELECT event_id AS region_id, user_id AS doc_id, CAST(event_id % 5 AS INTEGER) AS page_number, CAST(event_id % 7 AS INTEGER) AS ord,
  concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END, CAST(event_id % 4 AS VARCHAR(3))) AS text,
  event_type AS pii_type, CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REMOVE' WHEN 2 THEN 'TOKENIZE' ELSE 'CANCEL' END AS action, CASE WHEN event_id % 11 = 0 THEN 'MANUAL' ELSE 'REGEX' END AS source,
  CASE WHEN event_id % 3 = 0 THEN concat('g', CAST(event_id % 40 AS VARCHAR(3))) END AS linked_group, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
  CAST(event_id % 600 AS DOUBLE) AS x0, CAST(event_id % 800 AS DOUBLE) AS y0, CAST(event_id % 600 + 50 AS DOUBLE) AS x1, CAST(event_id % 800 + 12 AS DOUBLE) AS y1 FROM events"""
_CHOSEN = "SELECT event_id AS region_id FROM events WHERE event_type = 'error' AND value < 10"


def _table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    name = sql.rsplit(" FROM ", 1)[1].split()[0]
    return spark.sql(sql.replace(f" FROM {name}", " FROM {rows}"), rows=load(spark, sf_dir, name))


_CURRENT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id DESC) AS r FROM ({_SUBSCRIPTIONS}) WHERE status IN ('active', 'trialing')) WHERE r = 1)"
_ASKED = f"""(SELECT q.user_id, q.fingerprint, s.plan, s.seats, s.status = 'trialing' AND s.trial_end < {NOW} AS over, coalesce(u.n, 0) AS used, EXISTS (SELECT 1 FROM ({_MACHINES}) m WHERE m.is_active AND m.user_id = q.user_id AND m.fingerprint = q.fingerprint) AS here,
  q.fingerprint IN ({_TRIALS}) AS had FROM ({_REQUESTS}) q LEFT JOIN {_CURRENT} s ON s.user_id = q.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM ({_MACHINES}) WHERE is_active GROUP BY 1) u ON u.user_id = q.user_id)"""
_FIRST = "CASE WHEN plan IS NULL THEN 'no subscription' WHEN over THEN 'trial expired'"


@query(f"""SELECT c.c_custkey AS user_id, s.status IS NOT NULL AS valid, s.plan, s.seats, coalesce(s.current_period_end, s.trial_end) AS expires_at,
CAST(floor((epoch_us(coalesce(s.current_period_end, s.trial_end)) - epoch_us({NOW})) / 86400000000) AS INTEGER) AS days_remaining, CASE WHEN s.status IS NOT NULL THEN 'Active' ELSE 'No active subscription' END AS message FROM customer c LEFT JOIN {_CURRENT} s ON s.user_id = c.c_custkey""")
def license_status(spark, sf_dir):
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return accounts.license_status(users, _table(spark, sf_dir, _SUBSCRIPTIONS), F.expr(NOW))


@query(f"SELECT user_id, fingerprint, {_FIRST} WHEN plan = 'free_trial' AND had THEN 'trial used' WHEN here THEN 'refreshed' WHEN used >= 3 * seats THEN 'limit reached' ELSE 'activated' END AS outcome FROM {_ASKED}")
def license_activate(spark, sf_dir):
    s, m, q, t = (_table(spark, sf_dir, x) for x in (_SUBSCRIPTIONS, _MACHINES, _REQUESTS, _TRIALS))
    return accounts.activation(q, s, m, t, F.expr(NOW))


@query(f"SELECT user_id, fingerprint, {_FIRST} WHEN here THEN 'valid' ELSE 'not activated' END AS outcome FROM {_ASKED}")
def license_validate(spark, sf_dir):
    s, m, q = (_table(spark, sf_dir, x) for x in (_SUBSCRIPTIONS, _MACHINES, _REQUESTS))
    return accounts.validation(q, s, m, F.expr(NOW))


@query(f"SELECT user_id, fingerprint, {_FIRST} WHEN NOT here AND used >= 3 * seats THEN 'limit reached' ELSE 'issued' END AS outcome FROM {_ASKED}")
def license_offline_key(spark, sf_dir):
    s, m, q = (_table(spark, sf_dir, x) for x in (_SUBSCRIPTIONS, _MACHINES, _REQUESTS))
    return accounts.offline_key(q, s, m, F.expr(NOW))


_OFF = f"(SELECT * FROM ({_MACHINES}) WHERE machine_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000))"


@query(f"SELECT machine_id, user_id, fingerprint, is_active AND machine_id NOT IN (SELECT machine_id FROM {_OFF}) AS is_active FROM ({_MACHINES})")
def machines_deactivate(spark, sf_dir):
    chosen = load(spark, sf_dir, "orders").where("o_totalprice < 50000").select(F.col("o_orderkey").alias("machine_id"))
    return accounts.deactivate(_table(spark, sf_dir, _MACHINES), _table(spark, sf_dir, _KEYS), chosen)[0]


@query(f"SELECT k.key_id, k.fingerprint, k.revoked OR EXISTS (SELECT 1 FROM {_OFF} o WHERE o.user_id = k.user_id AND o.fingerprint = k.fingerprint) AS revoked FROM ({_KEYS}) k")
def keys_of_deactivated(spark, sf_dir):
    chosen = load(spark, sf_dir, "orders").where("o_totalprice < 50000").select(F.col("o_orderkey").alias("machine_id"))
    return accounts.deactivate(_table(spark, sf_dir, _MACHINES), _table(spark, sf_dir, _KEYS), chosen)[1].select("key_id", "fingerprint", "revoked")


@query(f"SELECT q.fingerprint, q.user_id IS NOT NULL AND EXISTS (SELECT 1 FROM ({_KEYS}) k WHERE k.fingerprint = q.fingerprint) AND NOT EXISTS (SELECT 1 FROM ({_KEYS}) k WHERE k.fingerprint = q.fingerprint AND NOT k.revoked) AS revoked FROM ({_REQUESTS}) q")
def license_revocation(spark, sf_dir):
    return accounts.revocation(_table(spark, sf_dir, _REQUESTS), _table(spark, sf_dir, _KEYS))


@query(f"SELECT c_custkey AS user_id, (SELECT count(*) FROM ({_KEYS}) k WHERE k.user_id = c_custkey) AS revoked_keys, (SELECT count(*) FROM ({_MACHINES}) m WHERE m.user_id = c_custkey) AS deactivated_machines FROM customer")
def users_revoke(spark, sf_dir):
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return accounts.revoke_users(users, _table(spark, sf_dir, _MACHINES), _table(spark, sf_dir, _KEYS))


_UPDATES = "SELECT event_id, (event_id * 13) % 16000 AS subscription_id, ts AS happened, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 'active' WHEN event_type = 'view' THEN 'past_due' ELSE 'canceled' END AS status, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 30 DAY END AS current_period_end FROM events"


@query(f"""WITH u AS ({_UPDATES}), s AS (SELECT subscription_id, last(status ORDER BY happened, event_id) FILTER (WHERE status IS NOT NULL) AS status, last(current_period_end ORDER BY happened, event_id) FILTER (WHERE current_period_end IS NOT NULL) AS ends, bool_or(status = 'active') AS active FROM u GROUP BY 1)
SELECT o.subscription_id, CASE WHEN o.plan = 'free_trial' AND coalesce(s.active, false) THEN 'pro' ELSE o.plan END AS plan, coalesce(s.status, o.status) AS status, coalesce(s.ends, o.current_period_end) AS current_period_end FROM ({_SUBSCRIPTIONS}) o LEFT JOIN s ON s.subscription_id = o.subscription_id""")
def subscription_updates(spark, sf_dir):
    out = accounts.apply_updates(_table(spark, sf_dir, _SUBSCRIPTIONS), _table(spark, sf_dir, _UPDATES))
    return out.select("subscription_id", "plan", "status", "current_period_end")


@query(f"SELECT key_id FROM ({_KEYS}) WHERE expires_at >= {NOW} - INTERVAL 90 DAY")
def keys_purge(spark, sf_dir):
    return accounts.purge_keys(_table(spark, sf_dir, _KEYS), F.expr(NOW)).select("key_id")


@query("SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 43200000000")
def progress_ttl(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("now"))
    return accounts.fresh(e.join(F.broadcast(last)), F.col("now"), 43_200, "ts").select("event_id")  # one row


# Edits of regions.

_SPREAD = f"(SELECT DISTINCT doc_id, linked_group FROM ({_REGIONS}) WHERE region_id IN ({_CHOSEN}) AND linked_group IS NOT NULL)"


@query(f"SELECT region_id FROM ({_REGIONS}) r WHERE region_id NOT IN ({_CHOSEN}) AND NOT EXISTS (SELECT 1 FROM {_SPREAD} g WHERE g.doc_id = r.doc_id AND g.linked_group = r.linked_group)")
def regions_delete(spark, sf_dir):
    return mutations.delete(_table(spark, sf_dir, _REGIONS), _table(spark, sf_dir, _CHOSEN)).select("region_id")


@query(f"SELECT region_id, CASE WHEN region_id IN ({_CHOSEN}) THEN 'REMOVE' ELSE action END AS action FROM ({_REGIONS})")
def regions_batch_action(spark, sf_dir):
    return mutations.batch_action(_table(spark, sf_dir, _REGIONS), _table(spark, sf_dir, _CHOSEN), "REMOVE").select("region_id", "action")


@query(f"SELECT region_id FROM ({_REGIONS}) WHERE region_id NOT IN ({_CHOSEN})")
def regions_batch_delete(spark, sf_dir):
    return mutations.batch_delete(_table(spark, sf_dir, _REGIONS), _table(spark, sf_dir, _CHOSEN)).select("region_id")


def _same_text_sql(column: str, value: str) -> str:
    return f"""WITH r AS (SELECT *, lower(trim(text)) AS k FROM ({_REGIONS})), c AS (SELECT r.*, {value} AS v FROM r WHERE region_id IN ({_CHOSEN})),
    t AS (SELECT doc_id, k, arg_min(v, region_id) AS v FROM c WHERE k <> '' GROUP BY 1, 2)
    SELECT r.region_id, coalesce(c.v, t.v, r.{column}) AS {column} FROM r LEFT JOIN c ON c.region_id = r.region_id LEFT JOIN t ON t.doc_id = r.doc_id AND t.k = r.k"""


@query(_same_text_sql("pii_type", "concat('T', CAST(r.region_id % 5 AS VARCHAR(3)))"))
def regions_relabel(spark, sf_dir):
    changes = _table(spark, sf_dir, _CHOSEN).withColumn("pii_type", F.concat(F.lit("T"), (F.col("region_id") % 5).cast("string")))
    return mutations.relabel(_table(spark, sf_dir, _REGIONS), changes).select("region_id", "pii_type")


@query(_same_text_sql("text", "concat('new ', CAST(r.region_id % 5 AS VARCHAR(3)))"))
def regions_edit_text(spark, sf_dir):
    changes = _table(spark, sf_dir, _CHOSEN).withColumn("text", F.concat(F.lit("new "), (F.col("region_id") % 5).cast("string")))
    return mutations.edit_text(_table(spark, sf_dir, _REGIONS), changes).select("region_id", "text")


_BOXES = "SELECT event_id AS region_id, CAST(event_id % 900 - 100 AS DOUBLE) AS x0, CAST(event_id % 1100 - 100 AS DOUBLE) AS y0, CAST(event_id % 900 AS DOUBLE) AS x1, CAST(event_id % 1100 AS DOUBLE) AS y1 FROM events WHERE event_type = 'error' AND value < 10"
_IN = lambda v, size: f"greatest(0.0, least({v}, {size}))"


@query(f"""SELECT r.region_id, {", ".join(f"CASE WHEN b.region_id IS NULL THEN r.{c} WHEN r.page_number = 4 THEN b.{c} ELSE {_IN(f'b.{c}', s)} END AS {c}" for c, s in (("x0", "CAST(612 AS DOUBLE)"), ("y0", "CAST(792 AS DOUBLE)"), ("x1", "CAST(612 AS DOUBLE)"), ("y1", "CAST(792 AS DOUBLE)")))}
FROM ({_REGIONS}) r LEFT JOIN ({_BOXES}) b ON b.region_id = r.region_id""")
def regions_move(spark, sf_dir):
    r = _table(spark, sf_dir, _REGIONS)
    pages = r.where("page_number < 4").select("doc_id", "page_number").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return mutations.move(r, _table(spark, sf_dir, _BOXES), pages).select("region_id", "x0", "y0", "x1", "y1")


@query(f"""SELECT r.region_id, coalesce(b.x0, r.x0) AS x0, coalesce(b.y1, r.y1) AS y1, CASE WHEN b.region_id IS NULL THEN r.action ELSE 'CANCEL' END AS action FROM ({_REGIONS}) r LEFT JOIN ({_BOXES}) b ON b.region_id = r.region_id""")
def regions_sync(spark, sf_dir):
    state = _table(spark, sf_dir, _BOXES).withColumn("action", F.lit("CANCEL"))
    return mutations.sync(_table(spark, sf_dir, _REGIONS), state).select("region_id", "x0", "y1", "action")


@query(f"SELECT region_id FROM ({_REGIONS}) WHERE NOT (pii_type IN ('click', 'error') AND page_number IN (1, 2) AND source <> 'MANUAL')")
def regions_without_types(spark, sf_dir):
    r = _table(spark, sf_dir, _REGIONS)
    scanned = r.where("page_number IN (1, 2)").select("doc_id", "page_number")
    return mutations.without_types(r, ["click", "error"], scanned).select("region_id")


@query(f"SELECT region_id, source FROM ({_REGIONS}) WHERE page_number <> 3 OR source = 'MANUAL' UNION ALL SELECT region_id, 'AGAIN' AS source FROM ({_REGIONS}) WHERE page_number = 3 AND confidence >= 0.5")
def regions_redetect(spark, sf_dir):
    r = _table(spark, sf_dir, _REGIONS)
    found = r.where("confidence >= 0.5").withColumn("source", F.lit("AGAIN"))
    return mutations.redetected(r, found, r.where("page_number = 3").select("doc_id", "page_number")).select("region_id", "source")


@query(f"SELECT pii_type, confidence, source, substr(text, 1, 80) AS text, page_number, ord FROM ({_REGIONS})")
def debug_listing(spark, sf_dir):
    return mutations.debug_listing(_table(spark, sf_dir, _REGIONS))


# Sinks and structured documents.

_STORED = "SELECT c_custkey AS doc_id, c_name AS original_filename, '' AS anonymized_filename, CAST(-1 AS BIGINT) AS processed_at, c_nationkey AS page_count FROM customer"
_DONE = "SELECT o_custkey * 2 AS doc_id, concat('f', CAST(o_orderkey AS VARCHAR(9))) AS original_filename, o_orderpriority AS anonymized_filename, o_orderkey AS processed_at, CAST(o_orderkey % 9 AS INTEGER) AS page_count FROM orders"


@query(f"""WITH n AS (SELECT * FROM ({_DONE}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC) = 1)
SELECT * FROM ({_STORED}) WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def vault_register(spark, sf_dir):
    return sinks.register(_table(spark, sf_dir, _STORED), _table(spark, sf_dir, _DONE))


_CELLS = [("the", "---"), ("and", "[U00001]"), ("er", "[U00002]")]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text")


@query("SELECT concat_ws('-', conv_id, turn) AS id, replace(replace(replace(role, 'the', '---'), 'and', '[U00001]'), 'er', '[U00002]') AS role, replace(replace(replace(text, 'the', '---'), 'and', '[U00001]'), 'er', '[U00002]') AS text FROM conversations")
def redact_cells(spark, sf_dir):
    return structured.redact_cells(_cells(spark, sf_dir), _CELLS, ("id",))


@query("SELECT concat_ws('-', conv_id, turn) AS id, role, replace(text, 'the', '---') AS text FROM conversations")
def restore_cells(spark, sf_dir):
    vault = spark.createDataFrame([(token, old) for old, token in _CELLS[1:]], "token_string string, original_text string")
    return structured.restore_cells(redact_cells(spark, sf_dir), vault, "id")


_SPLIT = """SELECT source AS doc_id, page, CASE WHEN page % 3 <> 1 THEN size END AS size FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, octet_length(encode(coalesce(text, ''))) AS size FROM documents)"""


@query(f"""WITH RECURSIVE p AS ({_SPLIT}),
  w AS (SELECT *, max(CASE WHEN size IS NOT NULL THEN page END) OVER (PARTITION BY doc_id ORDER BY page) AS lo, min(CASE WHEN size IS NOT NULL THEN page END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM p),
  e AS (SELECT w.doc_id, w.page, CASE WHEN w.size IS NOT NULL THEN w.size WHEN w.hi IS NULL THEN a.size ELSE CAST(trunc(a.size + (w.page - w.lo) * 1.0::DOUBLE / (w.hi - w.lo) * (b.size - a.size)) AS BIGINT) END AS size
    FROM w LEFT JOIN p a ON a.doc_id = w.doc_id AND a.page = w.lo LEFT JOIN p b ON b.doc_id = w.doc_id AND b.page = w.hi),
  r AS (SELECT doc_id, page, size, size AS held, 1 AS part FROM e WHERE page = 0 UNION ALL
    SELECT e.doc_id, e.page, e.size, CASE WHEN r.held + e.size > 20000 THEN e.size ELSE r.held + e.size END, r.part + CASE WHEN r.held + e.size > 20000 THEN 1 ELSE 0 END FROM r JOIN e ON e.doc_id = r.doc_id AND e.page = r.page + 1)
  SELECT doc_id, page, size, part FROM r""")
def split_parts(spark, sf_dir):
    """Documents of a source, split into parts of 20,000 bytes; every third page is not measured."""
    d = load(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    pages = d.select(F.col("source").alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("page"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return splitting.split(pages.withColumn("size", F.when(F.col("page") % 3 != 1, F.col("size"))), 20_000).select("doc_id", "page", "size", "part")


_STANDING = "SELECT concat('report', CAST(o_orderkey % 9000 AS VARCHAR(9)), CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat(' (', CAST(o_custkey % 4 AS VARCHAR(9)), ')') END, '.txt') AS name FROM orders WHERE o_orderstatus = 'F'"


@query(f"""WITH w AS (SELECT c_custkey AS doc_id, concat('report', CAST(c_custkey % 500 AS VARCHAR(9))) AS root, row_number() OVER (PARTITION BY c_custkey % 500 ORDER BY c_custkey) AS turn FROM customer),
  s AS (SELECT DISTINCT name FROM ({_STANDING})),
  n AS (SELECT root, unnest(range(0, count(*) + 5)) AS n FROM w GROUP BY 1),
  f AS (SELECT root, n, row_number() OVER (PARTITION BY root ORDER BY n) AS turn FROM n WHERE concat(root, CASE WHEN n = 0 THEN '' ELSE concat(' (', CAST(n AS VARCHAR), ')') END, '.txt') NOT IN (SELECT name FROM s))
  SELECT doc_id, concat(w.root, CASE WHEN n = 0 THEN '' ELSE concat(' (', CAST(n AS VARCHAR), ')') END, '.txt') AS file_name FROM w JOIN f ON w.root = f.root AND w.turn = f.turn""")
def export_names(spark, sf_dir):
    """Names of many reports where others stand already."""
    wanted = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("report"), (F.col("c_custkey") % 500).cast("string")).alias("stem"), F.lit(".txt").alias("extension"))
    return export.numbered_names(wanted, _table(spark, sf_dir, _STANDING)).select("doc_id", "file_name")


# Rules of the engine on rows that have both outcomes.

_FORMS = "SELECT c_custkey, concat(c_name, CASE c_custkey % 7 WHEN 0 THEN ' Inc' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Income' WHEN 3 THEN ', Ltd.' WHEN 4 THEN ' S.A.' WHEN 5 THEN ' Agora' ELSE '' END) AS name FROM customer"


@query(f"SELECT c_custkey, regexp_matches(name, '(?i){spans.LEGAL.pattern}') AS legal FROM ({_FORMS})")
def legal_forms(spark, sf_dir):
    return _table(spark, sf_dir, _FORMS).select("c_custkey", document.legal_suffix(F.col("name")).alias("legal"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM customer")
def iban_check_digits(spark, sf_dir):
    """German numbers with the right check digits, or the next ones, for every other customer."""
    c = load(spark, sf_dir, "customer").withColumn("bban", F.lpad((F.col("c_custkey") * 7919 + 1).cast("string"), 18, "0"))
    rest = F.concat("bban", F.lit("131400")).cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")
    digits = (98 - rest.cast("int") + F.col("c_custkey") % 2) % 100
    number = F.concat(F.lit("DE"), F.lpad(digits.cast("string"), 2, "0"), "bban")
    return c.select("c_custkey", validators.iban(number).alias("valid"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'ring')")
def file_search(spark, sf_dir):
    """Names that hold what a user typed, in whatever case."""
    p = load(spark, sf_dir, "part")
    return p.where(F.contains(F.lower("p_name"), F.lower(F.lit("RING")))).select("p_partkey", "p_name", "p_size")


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS text FROM s""")
def web_text(spark, sf_dir):
    """The whole text of each web page."""
    return web_pages(load(spark, sf_dir, "pages")).select(F.col("page_number").alias("page_id"), "text")


def _either(words: list[str]) -> str:
    listed = "|".join(sorted({re.escape(w) for w in words}, key=lambda w: (-len(w), w))).replace("'", "''").replace("\\ ", " ").replace("\\-", "-")
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({listed})($|[^\p{{L}}\p{{N}}_])"


_PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@query(f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_PHONE}') AS m, string_split_regex(text, '{_PHONE}') AS g FROM documents WHERE regexp_matches(text, '{_PHONE}')),
  k AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
  s AS (SELECT doc_id, text, CAST(i - 1 AS INTEGER) AS ord, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, length(m[i]) AS n FROM k),
  w AS (SELECT doc_id, ord, substr(text, greatest(start - {spans.WINDOW}, 0) + 1, least(start, {spans.WINDOW})) AS before, substr(text, start + n + 1, {spans.WINDOW}) AS after FROM s)
  SELECT doc_id AS page_number, ord, CASE WHEN regexp_matches(before, '{_either(CONTEXT["PHONE"] + PHONE_LABELS)}') OR regexp_matches(after, '{_either(PHONE_LABELS)}') THEN CAST({spans.BOOST} AS DOUBLE) ELSE CAST(-{spans.PHONE_PENALTY} AS DOUBLE) END AS boost FROM w""")
def phone_boosts(spark, sf_dir):
    """What labels near them add to telephone numbers, by the detector's own rule."""
    pages = document_pages(load(spark, sf_dir, "documents"))
    return detect.boosts(detect.one_pattern(pages, _PHONE, "PHONE"), pages).select("page_number", "ord", "boost")


@query(f"SELECT region_id, page_number FROM ({_REGIONS}) WHERE page_number IN (2, 4)")
def regions_on_pages(spark, sf_dir):
    return mutations.on_pages(_table(spark, sf_dir, _REGIONS), [2, 4]).select("region_id", "page_number")
