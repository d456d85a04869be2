"""Queries: other detectors, the profile's attribution, checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import r6
from heronry.operators import entity as E
from heronry.operators import forest as O
from heronry.operators import masking as M
from heronry.operators import profile as P
from heronry.operators import tables as B
from heronry.plans import adapters as A
from heronry.plans.detection import DIST, SUBSETS, WIN_SQL
from heronry.plans.registry import query, table


@query()
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    """Detection by an isolation forest of windows, 200 trees."""
    lay = A.layouts(spark, d)
    return P.detection(O.isolation_forest(A.series(spark, d), lay, trees=200), lay).select("series_id", "p1_b0", "p1_bw", "argmax0")


@query()
def kmeans_detection(spark: SparkSession, d: str) -> DataFrame:
    lay = A.layouts(spark, d)
    return P.detection(O.kmeans_distance(A.series(spark, d), lay), lay).select("series_id", "p1_b0", "p1_bw", "argmax0")


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {WIN_SQL}, pr AS (SELECT q.series_id, q.start, min(round({DIST}, 9)) AS dist, arg_min(f.start, {{'a': round({DIST}, 9), 'b': f.start}}) AS nearest FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE f.start + 6 <= l.te AND q.start > s0 - 6 AND q.start < s1 GROUP BY ALL),
w AS (SELECT series_id, arg_min({{'s': start, 'n': nearest}}, {{'a': -dist, 'b': start}}) AS j FROM pr GROUP BY 1), k AS (SELECT w.series_id, w.j.s AS start, a.z AS za, b.z AS zb, unnest(range(0, 6)) AS k FROM w JOIN zw a ON a.series_id = w.series_id AND a.start = w.j.s JOIN zw b ON b.series_id = w.series_id AND b.start = w.j.n)
SELECT series_id, start + k AS idx, round((za[k + 1] - zb[k + 1]) * (za[k + 1] - zb[k + 1]), 6) AS v FROM k""")
def profile_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Which points make the worst window differ from its nearest one."""
    s, lay = A.series(spark, d), A.layouts(spark, d)
    near = (F.col("start") > F.col("s0") - F.col("w")) & (F.col("start") < F.col("s1"))
    return O.nearest_difference(O.z_windows(s, A.W), P.matrix_profile(s, lay, starts=near), lay).select("series_id", "idx", r6(F.col("v")).alias("v"))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def checked_join(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their regions; a repeated region key would be an error."""
    n = table(spark, d, "nation").withColumnRenamed("n_regionkey", "k")
    return B.join_checked(n, table(spark, d, "region").withColumnRenamed("r_regionkey", "k"), ["k"], validate="m:1").select("n_nationkey", "n_name", "r_name")


@query("WITH k AS (SELECT n_nationkey AS k, s.s AS seg FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer UNION SELECT 'NONE') s), f AS (SELECT c_nationkey AS k, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY ALL) SELECT k, seg, n FROM k LEFT JOIN f USING (k, seg)")
def aligned_grid(spark: SparkSession, d: str) -> DataFrame:
    """A fixed grid of keys, NULL where there is nothing. The grid is nations times segments, and one segment that nobody has."""
    c = table(spark, d, "customer")
    segs = c.select(F.col("c_mktsegment").alias("seg")).union(spark.createDataFrame([("NONE",)], "seg string")).distinct()
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).crossJoin(segs)  # a grid is what is asked for
    return B.align(c.groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n")), keys)


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ('0x' || substr(md5('7:' || p_partkey), 1, 12))::BIGINT, p_partkey) AS r FROM part) SELECT p_brand, p_partkey FROM h WHERE r = 1")
def collapse_variants(spark: SparkSession, d: str) -> DataFrame:
    """One member of each group, by seeded hash."""
    return B.one_of_each(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


@query("SELECT l_returnflag AS op, avg(l_discount) FILTER (WHERE l_linestatus = 'O') IS NOT NULL AS has_o, round(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 6) AS f, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1")
def pivoted_means(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide; each cell has one value by then."""
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("op"), "l_linestatus").agg(r6(F.avg("l_tax")).alias("v"))
    wide = B.pivot_strict(cells, "op", "l_linestatus", "v", ["F", "O"])
    return wide.select("op", F.col("O").isNotNull().alias("has_o"), F.col("F").alias("f"), F.col("O").alias("o"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL} SELECT num, domain, variant FROM meta WHERE domain IN ('click', 'view') AND variant NOT IN ('plain', 'NA') AND domain <> 'error'")
def selected_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Series that are in two named subsets at once."""
    return E.select_subsets(A.meta(spark, d), SUBSETS, ["clicks", "odd"]).select("num", "domain", "variant")


@query("WITH g AS (SELECT c_custkey AS num, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS root FROM customer) SELECT num, root, printf('cg%03d', root) AS \"group\", count(*) OVER (PARTITION BY root) AS group_size FROM g")
def group_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Labels of groups by their smallest member: customers of one nation and segment."""
    c = table(spark, d, "customer")
    links = c.select(F.col("c_custkey").alias("num"), F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("root"))
    return E.group_labels(links)


_NOISE = """rr AS (SELECT s.*, te, a, b, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd0, avg(x) FILTER (WHERE idx < te) OVER w AS mu, stddev_pop(x) FILTER (WHERE idx < te) OVER w AS tsd FROM s JOIN r USING (series_id) WINDOW w AS (PARTITION BY series_id)),
dr AS (SELECT *, ('0x' || substr(md5('7:' || series_id || ':' || idx || ':u'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u, ('0x' || substr(md5('7:' || series_id || ':' || idx || ':v'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS v,
       ('0x' || substr(md5('7:' || series_id || ':' || idx || ':n'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS e FROM rr WHERE idx >= a AND idx < b)"""


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.R_SQL}, {_NOISE} SELECT series_id, idx, 'gaussian' AS op, round(mean + CASE WHEN sd0 > 0 THEN sd0 ELSE 1e-8 END * sqrt(-2.0 * ln(1.0 - u)) * cos(6.283185307179586 * v), 5) AS masked FROM dr
UNION ALL SELECT series_id, idx, 'noise100', round((e * 200 - 100) * CASE WHEN tsd > 0 THEN tsd ELSE 1 END + mu, 5) FROM dr""")
def masked_noise(spark: SparkSession, d: str) -> DataFrame:
    """Seeded fills: normal numbers of the series' own spread, and even ones a hundred deviations wide."""
    p = A.points(spark, d)
    return M.mask_all(p, ("gaussian", "noise100")).join(p.select("series_id", "idx", "a", "b"), ["series_id", "idx"]).where("idx >= a AND idx < b").select("series_id", "idx", "op", F.round("masked", 5).alias("masked"))
