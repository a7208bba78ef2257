"""Sliding-window rate limiting: over a stored log, and over a stream.

A hit is allowed while fewer than `limit` allowed hits lie within the window before it (its start
included); rejected hits are not recorded and so block nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Limiter:
    """The rule for one key, hits in order of time (seconds)."""

    def __init__(self, limit: int, window: float, hits: list[float] | None = None):
        self.limit, self.window, self.hits = limit, window, deque(hits or ())

    def allow(self, now: float) -> bool:
        while self.hits and self.hits[0] < now - self.window:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False
        self.hits.append(now)
        return True


#: Paths that burn no quota.
EXEMPT_PREFIXES = ["/health", "/bitmaps/", "/storage-bitmaps/", "/assets/", "/api/warmup", "/api/llm/status", "/api/vault/status", "/api/settings", "/api/documents"]
EXEMPT_SUFFIXES = ["/detection-progress", "/regions"]


def exempt(path: Column, prefixes: list[str] = EXEMPT_PREFIXES, suffixes: list[str] = EXEMPT_SUFFIXES) -> Column:
    """Whether a path is never limited; a null path is."""
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    for p in suffixes:
        out = out | path.endswith(p)
    return F.coalesce(out, F.lit(False))


#: Events of a key are ordered by stretches of so many windows.
STRETCH = 1000


def runs(events: DataFrame, key: str, us: str, seconds: float) -> DataFrame:
    """Events with `run`: events of a key that a pause longer than the window parts are in different runs, and
    no hit of one run counts in another, so a hot key's events need not meet in one task.

    A run is named by its first time. Gaps are looked for within stretches of time; what came before a
    stretch is known from one row for each stretch."""
    window = int(seconds * 1_000_000)
    rows = events.withColumn("__c", F.floor(F.col(us) / F.lit(window * STRETCH)))
    inside = Window.partitionBy(key, "__c").orderBy(us)
    before = Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "__c").agg(F.max(us).alias("__last")).select(key, "__c", F.max("__last").over(before).alias("__prev"))
    joined = rows.join(ends.withColumnRenamed(key, "__k").withColumnRenamed("__c", "__d"), F.col(key).eqNullSafe(F.col("__k")) & F.col("__c").eqNullSafe(F.col("__d")))
    last = F.coalesce(F.lag(us).over(inside), "__prev")
    marked = joined.withColumn("__start", F.when(last.isNull() | (F.col(us) - last > window), F.col(us))).drop("__k", "__d", "__prev")
    started = marked.withColumn("__own", F.max("__start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = marked.groupBy(key, "__c").agg(F.max("__start").alias("__m")).select(F.col(key).alias("__k"), F.col("__c").alias("__d"), F.max("__m").over(before).alias("__carried"))
    out = started.join(firsts, F.col(key).eqNullSafe(F.col("__k")) & F.col("__c").eqNullSafe(F.col("__d")))
    return out.withColumn("run", F.coalesce("__own", "__carried")).select(*events.columns, "run")


def rate_limited(events: DataFrame, limit: int, seconds: float, key: str = "user_id", ts: str = "ts", order: str = "event_id", path: str | None = None) -> DataFrame:
    """Events with `allowed`; those on exempt paths, if there is a path, are allowed and count for nothing. Events of a key are parted at pauses longer than the window (see runs), and each
    run is streamed in order, batch by batch: state is the window alone. Events of a null key are one key;
    events without a time are not allowed."""
    if path:
        free = exempt(F.col(path))
        return rate_limited(events.where(~free), limit, seconds, key, ts, order).unionByName(events.where(free).withColumn("allowed", F.lit(True)))
    schema = events.withColumn("allowed", F.lit(True)).schema
    micros = F.unix_micros(F.col(ts)).alias("__us")
    parts = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = runs(events.select("*", micros), key, "__us", seconds)
    rows = parted.repartition(parts, key, "run").sortWithinPartitions(key, "run", "__us", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_key, rule = object(), None
        for batch in batches:
            allowed = []
            for k, run_, us in zip(batch.column(key).to_pylist(), batch.column("run").to_pylist(), batch.column("__us").to_pylist(), strict=True):
                if rule is None or (k, run_) != now_key:
                    now_key, rule = (k, run_), Limiter(limit, seconds)
                allowed.append(us is not None and rule.allow(us / 1e6))
            names = [n for n in batch.schema.names if n not in ("__us", "run")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(allowed)], names=[*names, "allowed"])

    return rows.mapInArrow(run, schema)


def stream_limited(stream: DataFrame, limit: int, seconds: float, key: str = "user_id", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """The same on a stream with applyInPandasWithState: the state of a key is its window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = f"{key} long, {ts} timestamp, allowed boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rule = Limiter(limit, seconds, list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(ts)
        allowed = [rule.allow(t.timestamp()) for t in rows[ts]]
        state.update((list(rule.hits),))
        state.setTimeoutTimestamp(int(rows[ts].max().timestamp() * 1000 + seconds * 1000) + 1)
        yield pd.DataFrame({key: k[0], ts: rows[ts], "allowed": allowed})

    marked = stream.withWatermark(ts, lateness).select(F.col(key).cast("long").alias(key), ts)
    return marked.groupBy(key).applyInPandasWithState(step, out, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_detect(stream: DataFrame, out_path: str, checkpoint: str, config=None):
    """Detection on pages as they arrive; every micro-batch is written as a whole, once."""
    from inkveil.operators.detect import detect
    from inkveil.operators.spans import Config

    found = detect(stream, config or Config())
    return found.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_event(stream: DataFrame, key: str = "event_id", ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Events once each, whatever is delivered twice within the lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
