"""Queries: detectors that are fitted once, profiles of long series, detectors in SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import r6
from heronry.operators import diagonals as D
from heronry.operators import masked as K
from heronry.operators import metrics as X
from heronry.operators import models as M
from heronry.operators import profile as P
from heronry.operators import series as S
from heronry.operators import table_functions
from heronry.plans import adapters as A
from heronry.plans.registry import SQL, query, table
from heronry.shared import shared_path, written

GATE = ("series_id", "max_anom", "thr_b0", "thr_bw", "p1_b0", "p1_bw", "argmax0", "p2_archive", "p2_brief", "scale")


def _gate(scores: DataFrame, layouts: DataFrame) -> DataFrame:
    return P.detection(scores, layouts).select(*[r6(F.col(c)).alias(c) if c in ("max_anom", "thr_b0", "thr_bw", "scale") else F.col(c) for c in GATE])


@query(SQL["gate_detection"])
def stored_profile_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate by a stored profile: training parts are fitted and kept, and loaded again to score whole series."""
    s, lay = A.series(spark, d).select("series_id", "idx", "x"), A.layouts(spark, d)
    folder = shared_path(spark, "models")
    kept = M.fit_profile(s, lay, folder, "events")
    model = M.load(spark, folder, "events", "profile", kept.settings)
    return _gate(P.pad(M.score_profile(model, s), lay), lay)


@query()
def stored_forest(spark: SparkSession, d: str) -> DataFrame:
    """Detection by 200 stored trees a series; the rows of ``isolation_forest``, which a test compares."""
    s, lay = A.series(spark, d).select("series_id", "idx", "x"), A.layouts(spark, d)
    model = M.fit_forest(s, lay, shared_path(spark, "models"), "events", trees=200)
    return P.detection(M.score_forest(model, s), lay).select("series_id", "p1_b0", "p1_bw", "argmax0")


@query()
def stored_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Detection by stored centres; the rows of ``kmeans_detection``, which a test compares."""
    s, lay = A.series(spark, d).select("series_id", "idx", "x"), A.layouts(spark, d)
    model = M.fit_kmeans(s, lay, shared_path(spark, "models"), "events")
    return P.detection(M.score_kmeans(model, s), lay).select("series_id", "p1_b0", "p1_bw", "argmax0")


@query(SQL["gate_detection"])
def sql_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate in SQL text, with the detector as a table function."""
    table_functions.register(spark)
    A.series(spark, d).select("series_id", "idx", "x").join(A.layouts(spark, d), "series_id").createOrReplaceTempView("heronry_points")
    return spark.sql("""
        WITH scores AS (SELECT * FROM profile_scores(TABLE(heronry_points), 'ab_join')),
        marked AS (SELECT s.*, n, te, s0, s1, w, s.idx >= te AND NOT (s.idx >= s0 AND s.idx < s1) AS b0,
                          s.idx >= te AND NOT (s.idx >= s0 - w AND s.idx < s1 + w) AS bw
                   FROM scores s JOIN (SELECT DISTINCT series_id, n, te, s0, s1, w FROM heronry_points) l ON s.series_id = l.series_id),
        sums AS (SELECT series_id, s0, s1, max(score) FILTER (WHERE idx >= s0 AND idx < s1) AS max_anom,
                        percentile(score, 0.99) FILTER (WHERE b0) AS thr_b0, percentile(score, 0.99) FILTER (WHERE bw) AS thr_bw,
                        median(score) FILTER (WHERE bw) AS med_bw, min_by(idx, struct(-score, idx)) FILTER (WHERE idx >= te) AS argmax0
                 FROM marked GROUP BY series_id, s0, s1)
        SELECT series_id, round(max_anom, 6) AS max_anom, round(thr_b0, 6) AS thr_b0, round(thr_bw, 6) AS thr_bw,
               max_anom > thr_b0 AS p1_b0, max_anom > thr_bw AS p1_bw, argmax0,
               argmax0 + 1 > least(s0 + 1 - (s1 - s0), s0 + 1 - 100) AND argmax0 + 1 < greatest(s1 + (s1 - s0), s1 + 100) AS p2_archive,
               argmax0 >= s0 - 100 AND argmax0 < s1 + 100 AS p2_brief, round(CASE WHEN thr_bw - med_bw > 0 THEN thr_bw - med_bw END, 6) AS scale
        FROM sums""")


#: Orders of each priority as one long series.
LONG_SQL = """s AS (SELECT o_orderpriority AS series_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS x FROM orders),
l AS (SELECT series_id, floor(count(*) * 0.4)::BIGINT AS te FROM s GROUP BY 1),
wn AS (SELECT series_id, start, list_max(v) = list_min(v) AS flat, list_avg(v) AS mu, list_stddev_pop(v) AS sd, v FROM (SELECT series_id, idx AS start, list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM s) WHERE len(v) = 16),
zw AS (SELECT series_id, start, list_transform(v, lambda y: CASE WHEN flat THEN 0.0 ELSE (y - mu) / sd END) AS z FROM wn),
p AS (SELECT q.series_id, q.start, min(round(list_distance(q.z, f.z), 9)) AS dist FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE f.start + 16 <= te GROUP BY ALL)"""


@query(f"WITH {LONG_SQL} SELECT series_id, count(*)::BIGINT AS windows, round(max(dist), 6) AS farthest, arg_min(start, {{'a': -dist, 'b': start}}) AS at, round(avg(dist), 6) AS mean FROM p GROUP BY 1")
def long_profile(spark: SparkSession, d: str) -> DataFrame:
    """Prices of each priority's orders as one series: the window that is farthest from all of training, by tiles that are
    dealt out and skipped by bounds."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("o_totalprice").cast("double").alias("x"))
    lay = s.groupBy("series_id").agg(F.floor(F.count(F.lit(1)) * 0.4).alias("te")).withColumn("w", F.lit(16).cast("long"))
    p, _ = D.pruned_profile(s, lay)
    near = F.round("dist", 9)
    return p.groupBy("series_id").agg(F.count(F.lit(1)).alias("windows"), r6(F.max(near)).alias("farthest"), F.min_by("start", F.struct(-near, F.col("start"))).alias("at"), r6(F.avg(near)).alias("mean"))


def _explained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Series, layouts, segments and (series_id, k) of the series that can be explained."""
    s, lay = A.series(spark, d).select("series_id", "idx", "x"), A.layouts(spark, d)
    segs = S.segments(lay)
    return s, lay, segs, segs.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"))


def _whole(f: DataFrame) -> DataFrame:
    """Rows of the series of which every set has a score."""
    lacking = f.where("f IS NULL").select("series_id").distinct()
    return f.join(lacking, "series_id", "left_anti")


@query()
def detector_shap(spark: SparkSession, d: str) -> DataFrame:
    """Shapley values of the detector's score in the label: what each segment adds, masked by its donor; 2k + 2048 sets a series.

    Series in which some set has a run without a donor have no rows. The draws have no SQL; a test compares them with
    brute force.
    """
    s, lay, segs, sized = _explained(spark, d)
    sets = written(X.merged(X.coalitions(sized, 2 * F.col("k") + 2046)), "coalitions")
    f = written(K.masked_scores(s, lay, segs, sets), "masked-scores")
    return X.kernel_shap(_whole(f).select("series_id", "z", "weight", "f")).select("series_id", "seg", F.round("value", 6).alias("value"))


@query()
def detector_ablation(spark: SparkSession, d: str) -> DataFrame:
    """What the detector's score in the label loses when one segment is masked by its donor."""
    s, lay, segs, sized = _explained(spark, d)
    one = sized.withColumn("seg", F.explode(F.expr("sequence(-1L, k - 1)")))
    sets = one.select("series_id", "seg", F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: (i != F.col("seg")).cast("int")).alias("z"))
    f = written(K.masked_scores(s, lay, segs, sets), "masked-scores")
    whole = f.where("seg < 0").select("series_id", F.col("f").alias("f0"))
    return X.ablation(whole, f.where("seg >= 0 AND f IS NOT NULL").select("series_id", "seg", "f")).select("series_id", "seg", r6(F.col("value")).alias("value"))


@query()
def run_donors(spark: SparkSession, d: str) -> DataFrame:
    """For every run of adjacent segments how many donors are listed, and the best."""
    s, lay, segs, _ = _explained(spark, d)
    t = K.donor_table(s, lay, segs)
    return t.select("series_id", "a", "b", F.size("u").alias("listed"), F.get("u", 0).alias("u"), F.round(F.get("d", 0), 6).alias("d"))
