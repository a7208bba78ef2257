"""Importance resampling towards a target distribution, over hashed word features.

A vectorised automaton reads the UTF-8 buffer of an Arrow batch: a table of 256 entries says which bytes
belong to words (A-Z lower-cased before), differences of neighbours give the starts and ends of words,
and table-driven CRCs advance over all starts at once, byte by byte, longest words first. Features are
runs of 1 to `longest` consecutive words joined by one space; a feature's bucket is its CRC modulo `buckets`.

Two passes over the texts. The first counts buckets in the corpus and in the target (a partition sends one
row for each bucket that it met, so the counts shuffle little whatever words are common); the second sums the
gains of each document's features. Documents are ranked by a range partition with a count per partition, so
no task sees all of them.

Only the table of gains, one number a bucket, passes through the driver: its size is the parameter `buckets`.

Defined results: a null or empty text has no features, weight 0, and is not drawn unless `least_words` is 0;
a null id hashes as the empty string; every row gets a result, repeated rows and null ids included (each may
be drawn; ties go to the smaller id, null first, then in any order among rows alike); a row of a null target
text counts nothing; an empty corpus gives an empty result; an empty target leaves all gains to smoothing;
other columns are carried in `row`, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, arrow, load, tune, utf8, whole

#: Which bytes belong to words, after lower-casing: digits, letters, and all bytes of other characters.
WORD = np.zeros(256, np.int8)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of a word that the automaton takes; what is longer goes on word by word from the state reached.
STEPS = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


TABLE = _crc_table()
START = np.uint32(0xFFFFFFFF)


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of texts that lie one after the other."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = WORD[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge[:-1] == 1), np.flatnonzero(edge == -1)
    cuts = offs[(offs > 0) & (offs < len(data))]
    cuts = np.unique(cuts[(solid[cuts] == 1) & (solid[cuts + 1] == 1)])  # a word ends where its text does
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def step(state: np.ndarray, byte: np.ndarray | np.uint8) -> np.ndarray:
    return (state >> np.uint32(8)) ^ TABLE[(state ^ byte) & np.uint32(255)]


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states of CRCs after the bytes from starts to ends, all at once."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")  # those that go on are always the first ones
    at, left, s = starts[order], -lengths[order], state[order]
    for k in range(min(STEPS, int(-left[0])) if len(left) else 0):
        n = int(np.searchsorted(left, -k))
        s[:n] = step(s[:n], data[at[:n] + k])
    for i in range(int(np.searchsorted(left, -STEPS))):
        s[i] = np.uint32(zlib.crc32(data[at[i] + STEPS : at[i] - left[i]], int(~s[i]))) ^ START
    out = np.empty_like(s)
    out[order] = s
    return out


def features(text: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts: the bucket of each feature, the text that it is in, and the words of each text."""
    data, offs = utf8(text)
    data = LOWER[data]
    starts, ends = word_bounds(data, offs)
    n_words = np.diff(np.searchsorted(starts, offs))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    found, docs, state = [], [], np.full(len(starts), START)
    for k in range(longest):
        if k:  # runs of k words that go on within their text
            first = np.flatnonzero(doc[k:] == doc[: len(doc) - k]) if len(doc) > k else np.empty(0, np.int64)
            state = step(state[first], np.uint8(0x20))
        else:
            first = np.arange(len(starts))
        state = advance(state, data, starts[first + k], ends[first + k])
        found.append((state ^ START) % np.uint32(buckets))
        docs.append(doc[first])
        if k + 1 < longest:  # one state for each start again
            states = np.zeros(len(starts), np.uint32)
            states[first] = state
            state = states
    return np.concatenate(found), np.concatenate(docs), n_words


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts of a table with one column `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0), longest, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """For each bucket, a thousand times the logarithm of its smoothed share in the target over that in docs."""
    counted = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for n, texts in zip(counted, (docs, target), strict=True):
        for r in bucket_counts(texts, longest, buckets).collect():  # at most `buckets` rows
            n[r.bucket] = r.n
    s, t = counted
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, doc, n_words = features(batch.column("text"), longest, len(gain))
        weight = np.bincount(doc, gain[bucket], len(n_words)).astype(np.int64)  # exact below 2**53
        n = np.bincount(doc, minlength=len(n_words))
        return pa.record_batch([batch.column("row"), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))], names=["row", "n_words", "n_features", "weight"])

    return kernel


def ranked(rows: DataFrame, scratch: Scratch, share: tuple[int, int]) -> DataFrame:
    """`rank` from 1 by falling score, then by id, for the given share of rows; the others have null."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("tie")]
    dealt = scratch.save(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "dealt")
    n = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = n.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("n").over(every).alias("n_all"))
    place = F.col("n_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = dealt.join(F.broadcast(n), "part").withColumn("place", place)
    return out.withColumn("rank", F.when(F.col("place") <= F.expr(f"n_all * {share[0]} div {share[1]}"), F.col("place"))).drop("part", "place", "n_before", "n_all")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns in carry, all by default), n_words, n_features, weight, score and rank of
    every document. Those with a rank are drawn without replacement: Gumbel noise from a hash of (seed, id) on
    the weight, and the highest `share` of the documents with at least `least_words` words."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "importance")
    gain = gains(docs.select(whole(text_col).alias("text")), target.select(whole(text_col).alias("text")), longest, buckets)
    base = docs.select(F.struct(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), docs[id_col].alias("id")).alias("row"), whole(text_col).alias("text"))
    schema = base.select("row").schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    found = arrow(base, _weigh(gain, longest), schema).select("row.*", "n_words", "n_features", "weight")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = found.withColumn("score", F.col("weight") + noise).withColumn("tie", F.monotonically_increasing_id())
    found = scratch.save(found, "scored")
    drawn = ranked(found.where(F.col("n_words") >= least_words), scratch, share)
    rest = found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("id", "tie")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("row.doc_id", "n_features", "weight", "score", "rank")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The CRC of each distinct word, byte by byte, from a table of 256 entries made by its rule.
ORACLE_OP11 = f"""
WITH RECURSIVE t(i, c, k) AS (SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS a FROM t WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS h, octet_length(encode(w)) AS n FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
c AS (SELECT w, CAST(xor(list_reduce(list_transform(range(1, n + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS UBIGINT)),
    lambda s, x: xor(s >> 8, tab.a[CAST(xor(s, x) % 256 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS BIGINT) AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN c USING (w) GROUP BY 1),
q AS (SELECT bucket, count(*) AS n FROM bw JOIN c USING (w) GROUP BY 1),
g AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(q.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM q) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN q USING (bucket)),
f AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN c USING (w) JOIN g USING (bucket) GROUP BY r),
o AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) AS h FROM d LEFT JOIN f USING (r)),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM o),
e AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM e
"""
