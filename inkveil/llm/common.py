"""What the operators share: the shared folder, scratch tables, and vectorised word hashing.

Words are maximal runs of bytes other than space and \\x09-\\x0D, in the UTF-8 form of a text;
none of those six bytes occurs inside a multi-byte character, so bytes can be split safely.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 500
MASK = (1 << 64) - 1
_RELEASED = 0.0


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: memory of a Python worker is bounded by a batch. Spark cuts
    batches by bytes too (spark.sql.execution.arrow.maxBytesPerBatch), so long texts come a few at a time.
    The setting stays: results are computed when they are asked for, and read it then."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is missing, a folder of our own is made, on a local master only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not d and got.isDefined():
        d = got.get()
    if d:
        d = d.rstrip("/")
        return "file://" + d[5:] if d.startswith("file:/") and not d.startswith("file://") else d
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    d = "file://" + tempfile.mkdtemp(prefix="inkveil-")
    spark.sparkContext.setCheckpointDir(d)
    return shared_dir(spark)


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor loses nothing of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/inkveil-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", tidy: bool = True) -> DataFrame:
        """Write a table and read it back; tidy: have the shuffle files behind it deleted now."""
        df.write.option("compression", codec).parquet(self.path(name))
        if tidy:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of jobs whose result is stored: it does so once the
    driver has collected the objects that stand for them. What a second leaves can wait."""
    global _RELEASED
    if time.monotonic() - _RELEASED > 1:
        gc.collect()
        spark._jvm.System.gc()
        _RELEASED = time.monotonic()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key(*columns: str) -> list[Column]:
    """r1 and r2, which name a row by the columns: two independent 64-bit hashes."""
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit("r2"), *reversed(columns)).alias("r2")]


#: A key is hot with more than this share of all rows; so there are at most as many hot keys.
HOT_SHARE, HOT_LEAST = 1000, 1000


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that more than one in HOT_SHARE rows (and HOT_LEAST rows at least) have: HOT_SHARE keys at most."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return [r[0] for r in n.where(F.col("n") > max(HOT_LEAST, df.count() // HOT_SHARE)).select(key).collect()]


def join_each(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left joined with right, which has one row for a key: rows of hot keys where they stand, with their few
    rows of right sent to them, the rest by a plain join. So no task takes all rows of a hot key."""
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    there = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key)  # HOT_SHARE rows at most
    return there.unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


def arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a kernel from batch to batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := kernel(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls empty; the first offset is 0."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return data, offs - offs[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BLOCK = 1 << 20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        n = max(n, BLOCK + 1)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[base] = got = tuple(made)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a batch of texts: starts, ends (in bytes), and first[i], the number of words before text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, n = data, offs, len(data)
        self.n_docs = len(offs) - 1
        solid = ~SPACE[data]
        cut = offs[(offs > 0) & (offs < n)]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        before[cut] = False
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        after[cut - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)

    @classmethod
    def of(cls, col: pa.Array, lower: bool = False) -> Words:
        data, offs = utf8(col)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        return cls(data, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(self.n_docs), self.counts())

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; which: 0 or 1, independent of each other."""
        out, i, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        values, base = BYTE_VALUES[which], BASES[which]
        while i < n:
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, a + BLOCK, "right")))
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            up, down = powers(base, int(e[-1]) + 1)
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(values[self.data[a : a + e[-1]]] * up[: e[-1]], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out


def windows(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each run of `length` consecutive word hashes; fewer words give none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, step = np.empty(n, np.uint64), BLOCK
    up, down = powers(BASES[which] ^ 0x5A5A5A5A5A5A5A5A ^ 0, min(len(words), step + length) + 1)
    for i in range(0, n, step):
        part = words[i : i + step + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = min(step, n - i)
        out[i : i + m] = mix((total[length : length + m] - total[:m]) * down[:m] + np.uint64(length))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    ends = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
