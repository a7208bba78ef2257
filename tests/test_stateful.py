"""Streams against the log: limiter in event time, progress, observed counts."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkveil.operators.spans import Config
from inkveil.streaming import limiter, progress, stateful

EVENTS = "event_id long, user_id long, ts timestamp, path string"
START = datetime(2024, 1, 1)


def run(frame, name, mode, where, clock=0):
    """clock: state that time alone changes has batches without data for ever, so the query is stopped after so many rows."""
    writer = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(where))
    q = (writer.trigger(processingTime="1 second") if clock else writer.trigger(availableNow=True)).start()
    if clock:
        for _ in range(150):
            if frame.sparkSession.table(name).count() >= clock or q.exception():
                break
            time.sleep(0.2)
        q.stop()
    else:
        q.awaitTermination()
    return frame.sparkSession.table(name)


def batches(spark, rows, schema, where, n):
    """Rows dealt to n files, read one a micro-batch in the order of their names."""
    for k in range(n):
        spark.createDataFrame(rows[k::n] if n > 1 else rows, schema).coalesce(1).write.parquet(f"{where}/part={k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(where))


def test_exempt_paths(spark):
    paths = ["/health", "/healthy", "/api/x", "/api/documents/1", "/a/regions", "/regions/a", None]
    rows = spark.createDataFrame(list(enumerate(paths)), "i int, path string").select("i", limiter.exempt(F.col("path")).alias("free")).collect()
    assert [r.free for r in sorted(rows)] == [True, True, False, True, True, False, False]


def test_stream_says_what_the_log_says(spark, tmp_path):
    rng, rows, at = random.Random(7), [], 0.0
    for i in range(300):
        at += rng.choice([0, 0.5, 1, 2, 3, 30, 61])
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), START + timedelta(seconds=at), rng.choice(["/api/x", "/api/x", "/api/x", "/health", None])))
    rows += [(900, 1, None, "/api/x"), (901, 9, None, "/health")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    end = [(999, 99, START + timedelta(days=2), "/api/x")]
    got = stateful.stream_rate_limited(batches(spark, shuffled, EVENTS, tmp_path / "in", 5), 3, 60.0, lateness="1 day", path="path")
    spark.createDataFrame(end, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part=zzz")
    found = {r.event_id: (r.user_id, r.ts, r.allowed) for r in run(got, "limited_in_order", "append", tmp_path / "c").collect()}
    log = limiter.rate_limited(spark.createDataFrame(rows, EVENTS), 3, 60.0, path="path").collect()
    assert found == {r.event_id: (r.user_id, r.ts, r.allowed) for r in log} and {a for _, _, a in found.values()} == {True, False}


STEPS = "doc_id string, ts timestamp, status string, pages long, pages_total long, regions long"


def test_progress_adds_up_and_is_forgotten(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", at(0), "running", 1, 4, 2), ("a", at(5), "running", 2, 4, 0), ("b", at(1), "error", 0, None, None), ("a", at(9), "complete", 1, None, 5)]
    for ttl, done in ((300.0, 4), (0.001, 1)):
        where = tmp_path / f"in{done}"
        for k, part in enumerate((rows[:3], rows[3:])):
            spark.createDataFrame(part, STEPS).coalesce(1).write.parquet(f"{where}/part={k}")
        stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(where))
        got = [tuple(r) for r in run(stateful.progress(stream, ttl), f"progress{done}", "update", tmp_path / f"c{done}", clock=3).collect()]
        assert ("a", "running", 3, 4, 2, at(0), 5.0) in got and ("b", "error", 0, 0, 0, at(1), 0.0) in got
        assert (("a", "complete", 4, 4, 7, at(0), 9.0) if done == 4 else ("a", "complete", 1, 0, 5, at(9), 0.0)) in got


def test_observed_counts_are_those_of_the_result(spark, tmp_path):
    from inkveil.operators.detect import detect

    pages = "doc_id string, page_number long, text string"
    rows = [(f"d{k % 3}", k, f"Write to u{k}@example.org or call 192.168.1.{k} today please.") for k in range(12)]
    table, seen = progress.observed(detect(spark.createDataFrame(rows, pages), Config(language="en")))
    found = table.collect()
    by = seen.get
    assert by["regions"] == len(found) > 0 and by["documents"] == 3
    assert all(by[k] == sum(r.pii_type == k for r in found) for k in progress.TOKEN_LETTERS)
    told = []
    listener = progress.Snapshots(callback=lambda q, t: told.append((q, t["regions"])))
    spark.streams.addListener(listener)
    try:
        stream = batches(spark, rows, pages, tmp_path / "pages", 3)
        run(progress.observed_stream(detect(stream, Config(language="en"))), "watched", "append", tmp_path / "c")
        for _ in range(100):
            if listener.totals.get("watched", {}).get("regions") == len(found) and "watched" in listener.done:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    totals = listener.totals["watched"]
    assert totals["regions"] == len(found) and totals["EMAIL"] == by["EMAIL"] and len(told) >= 3 and "watched" in listener.done
