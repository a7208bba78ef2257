"""Counts of a run while it runs: observed metrics of a batch or a stream, without a job of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from inkveil.lexicon.words import TOKEN_LETTERS


def counts() -> list:
    """Regions, pages at least and surest find, and regions of each type."""
    kinds = [F.count_if(F.col("pii_type") == k).alias(k) for k in TOKEN_LETTERS]
    return [F.count(F.lit(1)).alias("regions"), F.approx_count_distinct("doc_id").alias("documents"), F.max("confidence").alias("surest"), *kinds]


def observed(regions: DataFrame, name: str = "detection") -> tuple[DataFrame, Observation]:
    """regions, and what counts them when they are written or collected: `observation.get` has the counts then."""
    seen = Observation(name)
    return regions.observe(seen, *counts()), seen


def observed_stream(regions: DataFrame, name: str = "detection") -> DataFrame:
    """A stream of regions that tells its listeners the counts of every micro-batch."""
    return regions.observe(name, *counts())


class Snapshots(StreamingQueryListener):
    """Running totals of the observed counts of streams, by the query's name (or id). Add it with spark.streams.addListener.

    `callback(query, totals)` is called with each micro-batch. Driver memory is one row a query."""

    def __init__(self, name: str = "detection", callback=None):
        self.name, self.callback = name, callback
        self.totals: dict[str, dict[str, float]] = {}
        self.done: set[str] = set()
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)
        self.totals.setdefault(event.name or str(event.id), {})

    def onQueryProgress(self, event) -> None:
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        query = event.progress.name or str(event.progress.id)
        held = self.totals.setdefault(query, {})
        for k, v in row.asDict().items():
            held[k] = max(held.get(k, 0), v or 0) if k in ("surest", "documents") else held.get(k, 0) + (v or 0)
        if self.callback:
            self.callback(query, dict(held))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.done.add(self._names.get(str(event.id), str(event.id)))
