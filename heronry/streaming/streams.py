"""Structured-streaming faces of the span log and the memory: counts by window, sessions, upserts, state with time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heronry.shared import shared_path
from heronry.sources.files import SPAN_SCHEMA


def stream_spans(spark: SparkSession, directory: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Appended span files as a stream, with the start as event time."""
    raw = spark.readStream.schema(SPAN_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(directory)
    return raw.withColumn("ts", F.timestamp_seconds("started_at"))


def windowed_counts(events: DataFrame, keys: list[str], *, window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes", time: str = "ts", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) by tumbling or sliding window; what comes ``late`` is dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def sessions(events: DataFrame, key: str, *, gap: str = "30 minutes", late: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], *, late: str = "30 minutes", time: str = "ts") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, on: Column, *, late: str = "30 minutes", left_time: str = "ts", right_time: str = "ts2") -> DataFrame:
    """Inner join of two streams; ``on`` bounds the difference of their times, so state is dropped."""
    return left.withWatermark(left_time, late).join(right.withWatermark(right_time, late), on)


def memory_state(log: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """(subject, key, value, alive): the latest value of each key of a log (subject, key, value, seq, ts, op, ttl_seconds), as it changes.

    State is one value a key. It ends when the watermark passes its time plus its time to live, which is reported once
    with alive false; entries older than the watermark are too late.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        subject, key = k
        if state.hasTimedOut:
            value = state.get[0]
            state.remove()
            yield pd.DataFrame({"subject": [subject], "key": [key], "value": [value], "alive": [False]})
            return
        last = pd.concat(list(rows)).sort_values("seq").iloc[-1]
        if last["op"] == "forget":
            if state.exists:
                state.remove()
            yield pd.DataFrame({"subject": [subject], "key": [key], "value": [None], "alive": [False]})
            return
        if state.exists and state.get[1] > int(last["seq"]):
            return
        state.update((last["value"], int(last["seq"])))
        if pd.notna(last["ttl_seconds"]):
            end = int(last["ts"].timestamp() * 1000 + last["ttl_seconds"] * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"subject": [subject], "key": [key], "value": [last["value"]], "alive": [True]})

    return log.withWatermark("ts", late).groupBy("subject", "key").applyInPandasWithState(step, "subject string, key string, value string, alive boolean", "value string, seq long", "update", GroupStateTimeout.EventTimeTimeout)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each batch in a folder of its own number: one that comes again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(df: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """All input there is through a stream into a table in the shared folder, which is returned.

    State checkpoints lie in the shared folder too. Under "complete" the last batch is the result.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.writeStream.outputMode(mode).foreachBatch(write_batch(f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(df.schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == query.recentProgress[-1]["batchId"])
    return rows.drop("batch")
