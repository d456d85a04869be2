"""State with timers: expiry, order, restart."""

import time
from datetime import datetime, timedelta

import pytest

from heronry.streaming import timers as T

SCHEMA = "subject string, key string, value string, seq long, ts timestamp, op string, ttl_seconds double"
BEGIN = datetime(2024, 1, 1)


def put(spark, folder, *rows):
    made = [(s, k, v, seq, BEGIN + timedelta(seconds=at), op, ttl) for s, k, v, seq, at, op, ttl in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, state, out, **how):
    log = spark.readStream.schema(SCHEMA).parquet(folder)
    writer = T.memory_timers(log, **how).writeStream.outputMode("update").option("checkpointLocation", state)
    seen = []

    def keep(batch, n):
        seen.extend(tuple(r) for r in batch.collect())
        out.extend(tuple(r) for r in batch.collect())

    return writer.foreachBatch(keep), seen


def test_entries_end_as_the_watermark_passes_and_state_survives_a_restart(spark, tmp_path):
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    got = []
    put(spark, folder, ("u", "a", "1", 1, 0, "put", 60.0), ("u", "b", "x", 1, 0, "put", None), ("v", "a", "old", 1, 0, "put", None), ("v", "a", "new", 2, 1, "put", None))
    writer, seen = run(spark, folder, state, got, late="1 second")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [("u", "a", "1", True), ("u", "b", "x", True), ("v", "a", "new", True)]
    put(spark, folder, ("w", "z", "later", 1, 600, "put", None), ("v", "a", "older still", 1, 2, "put", None))  # nothing for (u, a)
    writer, seen = run(spark, folder, state, got, late="1 second")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, seen)) == sorted(map(str, [("w", "z", "later", True), ("u", "a", "1", False)]))  # seq 1 of (v, a) is known to be old
    put(spark, folder, ("u", "b", None, 2, 700, "forget", None), ("u", "b", "y", 1, 700, "put", None), ("u", "a", "2", 2, 700, "put", 5.0))
    writer, seen = run(spark, folder, state, got, late="1 second")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, seen)) == sorted(map(str, [("u", "b", None, False), ("u", "a", "2", True)]))


def test_the_clock_ends_entries_without_any_input(spark, tmp_path):
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    got = []
    put(spark, folder, ("u", "a", "1", 1, 0, "put", 2.0), ("u", "b", "x", 1, 0, "put", 500.0))
    writer, seen = run(spark, folder, state, got, clock="ProcessingTime")
    query = writer.trigger(processingTime="1 second").start()
    until = time.time() + 60
    while ("u", "a", "1", False) not in seen and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert ("u", "a", "1", False) in seen and ("u", "b", "x", False) not in seen and query.exception() is None


def test_unknown_clock(spark):
    with pytest.raises(ValueError):
        T.memory_timers(spark.createDataFrame([], SCHEMA), clock="sundial")
