"""Queries over files as streams, run until all there is has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.numeric import r6
from heronry.plans.registry import query, table
from heronry.streaming import streams as T


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, with an event time that has a zone, as watermarks need."""
    schema = table(spark, d, "events").schema  # the pattern takes a file as well as a folder
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streamed_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day by type."""
    counts = T.windowed_counts(_events(spark, d), ["event_type"], window="1 day", value="value")
    out = T.run_available(counts, "daily", mode="complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6(F.col("total")).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1")
def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, ended by a gap of six hours."""
    s = T.run_available(T.sessions(_events(spark, d), "user_id", gap="6 hours"), "sessions", mode="complete")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
