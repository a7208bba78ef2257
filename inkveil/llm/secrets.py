"""Secret scans with an incremental ledger of blobs.

Each version of a text is a blob, named by its SHA-256. The ledger holds one row per scanned (blob,
rule version) pair with its findings; a run scans only pairs that the ledger lacks, appends them,
and joins the findings back to every row (path) that holds the blob.

Defined results: a null text is empty and has no findings; every input row gives one row, repeated
rows and null ids included; other columns are ignored, whatever their names; an empty table gives
an empty result. Copies of a blob are merged before the shuffle and scanned once. Offsets are code
points, ends exclusive. Kinds are matched apart, so spans of different kinds may overlap; within a
kind they are leftmost and do not overlap.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, arrow, hot_keys, join_each, load, tune, whole

#: Fixed rules; the first three are the base ones, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: A private key to its END line; where that is missing, its header lines and base64 body.
_GAP = r"(?:\s|\\r|\\n)+"
PEM = re.compile(rf"""-----BEGIN\x20([A-Z\x20]{{0,24}}PRIVATE\x20KEY)-----(?:(?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20\1-----
|(?:{_GAP}[A-Z][A-Za-z-]*:\x20[^\r\n]*)*(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{_GAP}[A-Za-z0-9+/]+={{1,2}}|\s*\n[A-Za-z0-9+/]+(?=[\x20\t\r]*(?:\n|\Z)))?(?:{_GAP}-----END\x20[A-Z\x20]{{0,24}}PRIVATE\x20KEY-----)?)""", re.VERBOSE)
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
HINTS = ("passw", "secret", "token", "api")
RULES = "\n".join(["1", *KINDS, ASSIGN.pattern, ACCESS.pattern, HEX.pattern, PEM.pattern, JWT.pattern])
RULE_VERSION = hashlib.sha256(RULES.encode()).hexdigest()[:16]
LEDGER = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, ranges array<struct<kind:string,start:int,end:int>>"


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end), sorted.

    A match too short is dropped but still uses up its characters: runs are matched greedily whole
    before their length is looked at."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(6)]
    for text in batch.column("text").to_pylist():
        spans = find_secrets(text)
        base = [x for x in spans if x[1] < 3]
        for k in range(3):
            out[k].append(sum(x[1] == k for x in base))
        out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out[4].append(joined(spans))
        out[5].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
    arrays = [batch.column("blob"), pa.array([RULE_VERSION] * batch.num_rows)] + [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
    return pa.record_batch(arrays, names=["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "ranges"])


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def scan_secrets(docs: DataFrame, ledger_path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: `row`, a struct of the columns in carry (all by default), and
    `secrets`, a struct of the findings in its blob (see LEDGER)."""
    spark = docs.sparkSession
    tune(spark)
    named = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), whole(text_col).alias("text"))
    named = named.withColumn("blob", F.unhex(F.sha2("text", 256)))
    seen = open_ledger(spark, ledger_path).where(F.col("rules") == RULE_VERSION).select("blob")
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    arrow(blobs.join(seen, "blob", "left_anti").select("blob", "text"), _scan, LEDGER).write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rules") == RULE_VERSION).dropDuplicates(["blob"])
    found = ledger.select("blob", F.struct("rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "ranges").alias("secrets"))
    rows = named.drop("text")
    return join_each(rows, found, "blob", hot_keys(rows, "blob")).drop("blob")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Scratch(spark, "secrets").path("ledger")
    out = scan_secrets(load(spark, sf_dir, "documents"), ledger, carry=["doc_id"])
    return out.select("row.doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5, which SQL can express."""
    return op5(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


ORACLE_COUNTS = """
SELECT doc_id,
CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS BIGINT) AS n_access,
CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24)) AS BIGINT) AS n_hex FROM documents
"""
