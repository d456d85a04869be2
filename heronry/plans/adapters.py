"""Views of the star-schema tables as series, layouts, spans, points and claims; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.operators import series as S
from heronry.plans.registry import table

W = 6

#: Common table expressions, to be joined with commas.
S_SQL = "s AS (SELECT user_id AS series_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS idx, value AS x, event_type FROM events)"
L_SQL = """sized AS (SELECT series_id, count(*)::BIGINT AS n, floor(count(*) * 0.4)::BIGINT AS te FROM s GROUP BY series_id),
l AS (SELECT series_id, n, te, min(idx) AS s0, min(idx) + 3 AS s1, 6::BIGINT AS w FROM sized JOIN s USING (series_id) WHERE event_type = 'error' AND idx >= te + 6 GROUP BY series_id, n, te HAVING min(idx) + 3 <= n)"""
META_SQL = """m AS (SELECT series_id, min(event_type) FILTER (WHERE c = top) AS domain FROM (SELECT series_id, event_type, c, max(c) OVER (PARTITION BY series_id) AS top FROM (SELECT user_id AS series_id, event_type, count(*) AS c FROM events GROUP BY ALL)) GROUP BY series_id),
meta AS (SELECT series_id AS num, domain, series_id // 3 AS name_group, CASE series_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'DISTORTED' ELSE 'NOISE' END AS variant, n AS length, te FROM m JOIN sized USING (series_id))"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """One series a user: values in the order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("value").alias("x"), "event_type")


def layouts(spark: SparkSession, d: str) -> DataFrame:
    return S.layout(series(spark, d), marked=F.col("event_type") == "error", w=W)


def meta(spark: SparkSession, d: str) -> DataFrame:
    """(num, domain, name_group, variant, length, te) of each series."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("num"), "event_type").agg(F.count(F.lit(1)).alias("c"))
    domain = e.groupBy("num").agg(F.min_by("event_type", F.struct(-F.col("c"), "event_type")).alias("domain"))
    size = series(spark, d).groupBy(F.col("series_id").alias("num")).agg(F.count(F.lit(1)).alias("length")).withColumn("te", F.floor(F.col("length") * 0.4))
    v = F.col("num") % 3
    return domain.join(size, "num").select("num", "domain", F.floor(F.col("num") / 3).alias("name_group"), F.when(v == 0, "plain").when(v == 1, "DISTORTED").otherwise("NOISE").alias("variant"), "length", "te")


# a region of three points, two windows after training, on the same rows as a layout
R_SQL = "r AS (SELECT *, te + 12 AS a, te + 15 AS b FROM l WHERE te + 15 <= n)"


def regions(spark: SparkSession, d: str) -> DataFrame:
    return layouts(spark, d).withColumn("a", F.col("te") + 2 * W).withColumn("b", F.col("a") + 3).where("b <= n")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Series points with their layout and region."""
    return series(spark, d).join(regions(spark, d), "series_id")


SPAN_SQL = """sp AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent_id, conv_id * 100 + turn AS seq,
  CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'refine:round' || turn ELSE role END AS name,
  CASE WHEN turn % 4 = 2 THEN 'selection' WHEN role = 'user' THEN 'human' WHEN role = 'system' THEN 'control' ELSE 'model' END AS kind,
  CASE WHEN conv_id % 11 <> 0 THEN 'c' || (conv_id % 5) END AS component, 'v' || (turn % 3) AS component_version,
  CASE WHEN length(text) % 7 = 0 THEN 'rejected' ELSE 'ok' END AS status, conv_id * 100.0::DOUBLE + turn AS started_at, conv_id * 100.0::DOUBLE + turn + length(text) / 128.0::DOUBLE AS ended_at,
  length(text) // 4 AS input_tokens, length(text) // 8 AS output_tokens, (length(text) % 97)::DOUBLE AS peak_vram_mb, length(text) // 4 AS absorbed_tokens, length(text) // 16 AS emitted_tokens,
  't' || (conv_id % 20) AS task_key, role || turn AS chosen, text FROM conversations)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as span trees: turn t hangs below turn (t - 1) div 2."""
    t, c, n = F.col("turn"), F.col("conv_id"), F.char_length("text")
    return table(spark, d, "conversations").select(
        c.alias("trace_id"), t.alias("span_id"), F.when(t > 0, F.floor((t - 1) / 2)).alias("parent_id"), (c * 100 + t).alias("seq"),
        F.when((F.col("role") == "assistant") & (t % 4 == 3), F.concat(F.lit("refine:round"), t)).otherwise(F.col("role")).alias("name"),
        F.when(t % 4 == 2, "selection").when(F.col("role") == "user", "human").when(F.col("role") == "system", "control").otherwise("model").alias("kind"),
        F.when(c % 11 != 0, F.concat(F.lit("c"), c % 5)).alias("component"), F.concat(F.lit("v"), t % 3).alias("component_version"),
        F.when(n % 7 == 0, "rejected").otherwise("ok").alias("status"), (c * F.lit(100.0) + t).alias("started_at"), (c * F.lit(100.0) + t + n / F.lit(128.0)).alias("ended_at"),
        F.floor(n / 4).alias("input_tokens"), F.floor(n / 8).alias("output_tokens"), (n % 97).cast("double").alias("peak_vram_mb"), F.floor(n / 4).alias("absorbed_tokens"), F.floor(n / 16).alias("emitted_tokens"),
        F.create_map(F.lit("task_key"), F.concat(F.lit("t"), c % 20), F.lit("chosen"), F.concat("role", t.cast("string"))).alias("attributes"), "text",
    )


POINT_SQL = """ship AS (SELECT l_orderkey, min(l_shipdate)::DATE AS published_at, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1),
pt AS (SELECT o_custkey AS key, o_totalprice AS value, o_orderdate::DATE AS period_end, CASE WHEN o_orderkey % 13 <> 0 THEN published_at END AS published_at, CASE WHEN last > published_at AND o_orderkey % 3 = 0 THEN last END AS restated_at, o_orderkey AS seq FROM orders JOIN ship ON o_orderkey = l_orderkey)"""


def data_points(spark: SparkSession, d: str) -> DataFrame:
    """Orders as bitemporal points: the order's day, the first shipping as publication, the last of some as restatement."""
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last"))
    o = table(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("date").alias("period_end"), F.when(F.col("o_orderkey") % 13 != 0, F.col("first")).alias("published_at"), F.when((F.col("last") > F.col("first")) & (F.col("o_orderkey") % 3 == 0), F.col("last")).alias("restated_at"), F.col("o_orderkey").alias("seq"))
