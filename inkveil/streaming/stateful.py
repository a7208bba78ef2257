"""Stateful stream operators: the rate limiter in event time, and the progress of documents.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass), which is set where no other was chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkveil.streaming.limiter import Limiter, exempt

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_store(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, _ROCKS)


class _OrderedLimiter(StatefulProcessor):
    """Hits of a key wait until the watermark has passed them, then are judged in order of time. State: what waits, and the
    allowed hits of the window. A timer stands at the first hit that waits, or at the end of the last one's window."""

    def __init__(self, limit: int, seconds: float, names: list[str]):
        self.limit, self.seconds, self.names = limit, seconds, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event long")
        self.hits = handle.getListState("hits", "us long")

    def _timer_at(self, us: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(math.ceil(us / 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(e)) for frame in rows for u, e in zip(frame["at_us"], frame["event_no"], strict=True)]
        first = min([u for u, _ in new] + [u for u, _ in self.waiting.get()])
        self.waiting.appendList(new)
        self._timer_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due, later = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        rule = Limiter(self.limit, self.seconds, [u / 1e6 for (u,) in self.hits.get()])
        allowed = [rule.allow(u / 1e6) for u, _ in due]
        live = [h for h in rule.hits if h * 1e6 >= until - self.seconds * 1e6]
        self.waiting.put(later) if later else self.waiting.clear()
        self.hits.put([(round(h * 1e6),) for h in live]) if live else self.hits.clear()
        if later:
            self._timer_at(later[0][0])
        elif live:  # nothing waits: the state goes when its window has passed
            self._timer_at(round((live[-1] + self.seconds) * 1e6) + 1000)
        if due:
            yield pd.DataFrame({self.names[0]: [key[0]] * len(due), self.names[1]: pd.Series([e for _, e in due], dtype="int64"), self.names[2]: pd.to_datetime([u for u, _ in due], unit="us"), "allowed": allowed})

    def close(self) -> None:
        pass


def stream_rate_limited(stream: DataFrame, limit: int, seconds: float, key: str = "user_id", ts: str = "ts", order: str = "event_id", lateness: str = "10 minutes", path: str | None = None) -> DataFrame:
    """key, order, ts and allowed of a stream of hits: what limiter.rate_limited says of them, in whatever micro-batches and
    order they arrive within the lateness.

    Verdicts come when the watermark has passed a hit; hits that arrive later than that are dropped. Hits on exempt paths
    (see limiter.exempt) are allowed at once and count for nothing; hits without a time are not allowed."""
    spark = stream.sparkSession
    _needs_store(spark)
    free = exempt(F.col(path)) if path else F.lit(False)
    kind = stream.select(key).schema[0].dataType.simpleString()
    marked = stream.withWatermark(ts, lateness)
    timed = marked.where(F.col(ts).isNotNull() & ~free).select(key, F.unix_micros(ts).alias("at_us"), F.col(order).cast("long").alias("event_no"), ts)
    judged = timed.groupBy(key).transformWithStateInPandas(_OrderedLimiter(limit, seconds, [key, order, ts]), f"{key} {kind}, {order} long, {ts} timestamp, allowed boolean", "Append", "EventTime")
    rest = marked.where(F.col(ts).isNull() | free).select(key, F.col(order).cast("long").alias(order), ts, free.alias("allowed"))
    return judged.unionByName(rest)


class _Progress(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "started timestamp, pages_done long, pages_total long, regions long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        started, done, total, regions = self.entry.get() if self.entry.exists() else (new["ts"].iloc[0], 0, 0, 0)
        done, regions = done + int(new["pages"].fillna(0).sum()), regions + int(new["regions"].fillna(0).sum())
        total = max(total, int(new["pages_total"].fillna(0).max()))
        started, last, status = pd.Timestamp(started), new["ts"].iloc[-1], new["status"].iloc[-1]
        self.entry.update((started.to_pydatetime(), done, total, regions))
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "pages_done": [done], "pages_total": [total], "regions": [regions], "started": [started], "elapsed_seconds": [(last - started).total_seconds()]})

    def close(self) -> None:
        pass


def progress(steps: DataFrame, ttl_seconds: float = 300.0) -> DataFrame:
    """A snapshot of every document that a micro-batch tells of: doc_id, status, pages_done, pages_total, regions, started
    and elapsed_seconds, from steps (doc_id, ts, status, pages, pages_total, regions), whose pages and regions add up.

    A document's entry is forgotten ttl_seconds after its last step (state TTL, so nothing scans for old entries); steps
    that come later start it anew. Write the result in update mode."""
    _needs_store(steps.sparkSession)
    out = "doc_id string, status string, pages_done long, pages_total long, regions long, started timestamp, elapsed_seconds double"
    rows = steps.select(F.col("doc_id").cast("string").alias("doc_id"), "ts", "status", "pages", "pages_total", "regions")
    return rows.groupBy("doc_id").transformWithStateInPandas(_Progress(int(ttl_seconds * 1000)), out, "Update", "ProcessingTime")
