"""Queries: faithfulness, localisation, statistics, resampling, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import numeric as N
from heronry.operators import metrics as X
from heronry.operators import rollups as U
from heronry.operators import series as S
from heronry.operators import stats as T
from heronry.plans import adapters as A
from heronry.plans.registry import query, table

r6 = N.r6

# effects of return flags and ship months (operator, attribution method) on suppliers
D_SQL = "dd AS (SELECT l_suppkey AS unit, l_returnflag AS op, 'am' || (month(l_shipdate) % 4) AS am, avg(l_discount - 0.05) AS v FROM lineitem GROUP BY ALL)"


def _effects(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("op"), F.concat(F.lit("am"), F.month("l_shipdate") % 4).alias("am")).agg(F.avg(F.col("l_discount") - 0.05).alias("v"))


def _ordered_effects(spark: SparkSession, d: str) -> DataFrame:
    """The effects, added in the order of the file as one thread of the SQL adds them: their signs hang on it."""
    l = U.in_file_order(table(spark, d, "lineitem"))  # noqa: E741
    l = l.select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("op"), F.concat(F.lit("am"), F.month("l_shipdate") % 4).alias("am"), (F.col("l_discount") - 0.05).alias("v"), "_file", "_row")  # noqa: E741
    return U.means_in_order(l, ["unit", "op", "am"], "v", ["_file", "_row"])


@query(f"""WITH {A.S_SQL}, z AS (SELECT *, count(*) OVER (PARTITION BY series_id) // 2 AS h FROM s), c AS (SELECT series_id, any_value(h) AS h, list(x ORDER BY idx) FILTER (WHERE idx < h) AS morf, list(x ORDER BY idx) FILTER (WHERE idx >= h AND idx < 2 * h) AS lerf, stddev_pop(x) AS sc FROM z GROUP BY 1),
e AS (SELECT series_id, sc, list_transform(range(0, h), lambda i: pow((h - i) / h::DOUBLE, 3.0)) AS w, list_transform(range(1, h + 1), lambda i: lerf[i] - morf[i]) AS df FROM c WHERE h >= 2)
SELECT series_id, round((list_inner_product(df, w) / list_sum(w)) / (sc * (list_sum(w) - 1.0) / list_sum(w)), 6) AS dds FROM e""")
def dds(spark: SparkSession, d: str) -> DataFrame:
    """Each series' first half as one curve, its second half as the other (of an odd number the last point has none)."""
    packed = A.series(spark, d).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("p"), F.stddev_pop("x").alias("sc")).where("size(p) >= 4")
    xs, half = F.transform("p", lambda q: q["x"]), F.floor(F.size("p") / 2).cast("int")
    out = packed.select("series_id", F.slice(xs, 1, half).alias("m"), F.slice(xs, half + 1, half).alias("l"), "sc")
    return out.select("series_id", r6(X.dds(F.col("m"), F.col("l"), F.col("sc"))).alias("dds"))


CELL_SQL = f"""{D_SQL}, ce AS (SELECT op, am, count(v) AS n, avg(v) AS mean, count_if(v > 0) AS pos, count_if(v < 0) AS neg, count_if(v = 0) AS zero, avg(sign(v)) AS pes, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM dd GROUP BY op, am),
cm AS (SELECT *, CASE WHEN mean * pes <= 0 THEN 0.0 ELSE 2 / (1 / abs(mean) + 1 / abs(pes)) END AS cmi FROM ce)"""


@query(f"""WITH {CELL_SQL} SELECT op, am, n, round(mean, 6) AS mean, pos, neg, zero, round(pes, 6) AS pes, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(q75 - q25, 6) AS iqr, round(cmi, 6) AS cmi,
CASE WHEN mean = 0 OR pes = 0 THEN 'zero' WHEN mean > 0 AND pes > 0 THEN '(+,+)' WHEN mean < 0 AND pes < 0 THEN '(-,-)' ELSE 'conflict' END AS sign_type FROM cm""")
def pes_cmi(spark: SparkSession, d: str) -> DataFrame:
    out = X.cell_summary(_ordered_effects(spark, d), ["op", "am"], "v").withColumn("sign_type", N.sign_type(F.col("mean"), F.col("pes")))
    return out.select("op", "am", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "pes", "q25", "q50", "q75", "iqr", "cmi")], "pos", "neg", "zero", "sign_type")


# ranks go by values rounded first, so that ties don't hang on the order of a sum
RANK_SQL = f"{D_SQL}, mn AS (SELECT op, am, round(avg(v), 9) AS v FROM dd GROUP BY ALL), rk AS (SELECT op, am, v, rank() OVER (PARTITION BY op ORDER BY v DESC) + (count(*) OVER (PARTITION BY op, v) - 1) / 2.0::DOUBLE AS rank FROM mn)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    mean = _effects(spark, d).groupBy("op", "am").agg(F.round(F.avg("v"), 9).alias("v"))
    return mean.withColumn("rank", N.average_rank(F.col("v"), ["op"]))


@query(f"WITH {RANK_SQL} SELECT op, am, rank FROM rk")
def am_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("op", "am", "rank")


@query(f"WITH {RANK_SQL}, t AS (SELECT am, sum(rank) AS r, count(DISTINCT op) AS m FROM rk GROUP BY 1), v AS (SELECT *, r - avg(r) OVER () AS dv FROM t) SELECT round(12 * sum(dv * dv) / (max(m) * max(m) * (count(*) * count(*) * count(*) - count(*))), 6) AS w, max(m)::DOUBLE AS m, count(*)::DOUBLE AS n FROM v")
def kendall_w(spark: SparkSession, d: str) -> DataFrame:
    return T.kendall_w(_ranks(spark, d), [], rater="op", item="am").select(r6(F.col("w")).alias("w"), "m", "n")


@query("""WITH v AS (SELECT user_id, event_type, round(avg(value), 9) AS value FROM events GROUP BY ALL), j AS (SELECT a.event_type AS rater_a, b.event_type AS rater_b, a.value AS va, b.value AS vb FROM v a JOIN v b USING (user_id) WHERE a.event_type < b.event_type),
r AS (SELECT rater_a, rater_b, rank() OVER (PARTITION BY rater_a, rater_b ORDER BY va) + (count(*) OVER (PARTITION BY rater_a, rater_b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY rater_a, rater_b ORDER BY vb) + (count(*) OVER (PARTITION BY rater_a, rater_b, vb) - 1) / 2.0 AS rb FROM j)
SELECT rater_a, rater_b, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY ALL""")
def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement of event types over users."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("value"))
    return T.spearman_pairs(v, rater="event_type", item="user_id").select("rater_a", "rater_b", r6(F.col("rho")).alias("rho"), "n")


@query("""WITH v AS (SELECT o_orderpriority AS k, month(o_orderdate) AS item, count(*) AS x, round(avg(o_totalprice), 6) AS y FROM orders GROUP BY ALL), p AS (SELECT a.k, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM v a JOIN v b ON a.k = b.k AND a.item < b.item)
SELECT k, round(sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0), 6) AS tau FROM p GROUP BY k""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.month("o_orderdate").alias("item")).agg(F.count(F.lit(1)).alias("x"), F.round(F.avg("o_totalprice"), 6).alias("y"))
    return T.kendall_tau(v, ["k"]).select("k", r6(F.col("tau")).alias("tau"))


@query("""WITH c AS (SELECT n_regionkey AS k, s_nationkey AS test, count(*) AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL), t AS (SELECT k, test, round(1.0::DOUBLE / (1 + c * (test % 5 + 1)), 9) AS p FROM c), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, test) AS i, count(*) OVER (PARTITION BY k) AS n FROM t)
SELECT k, test, p, round(least(1.0, max((n - i + 1) * p) OVER (PARTITION BY k ORDER BY i)), 6) AS p_holm FROM i""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    t = s.groupBy(F.col("n_regionkey").alias("k"), F.col("s_nationkey").alias("test")).agg(F.round(F.lit(1.0) / (1 + F.count(F.lit(1)) * (F.col("s_nationkey") % 5 + 1)), 9).alias("p"))
    return T.holm(t, ["k"]).select("k", "test", "p", r6(F.col("p_holm")).alias("p_holm"))


@query("""WITH c AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS n, count_if(o_orderstatus = 'F')::DOUBLE AS h FROM orders GROUP BY 1), z AS (SELECT *, h / n AS p, 1.959963984540054 * 1.959963984540054 AS z2 FROM c)
SELECT k, n::BIGINT AS n, round(greatest(0.0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)), 6) AS lo, round(least(1.0, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)), 6) AS hi FROM z""")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("h"))
    lo, hi = N.wilson(F.col("h"), F.col("n"))
    return c.select("k", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("""WITH c AS (SELECT user_id % 10 AS k, user_id, corr(value, epoch(ts)) AS r FROM events GROUP BY ALL) SELECT k, round(tanh(avg(atanh(least(greatest(r, -0.999999), 0.999999)))), 6) AS r, count(r) AS n FROM c GROUP BY k""")
def fisher_mean(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("k"), "user_id").agg(F.corr("value", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("r"))
    return c.groupBy("k").agg(r6(N.fisher_mean(F.col("r"))).alias("r"), F.count("r").alias("n"))


BOOT = 2000


def draw_sql(name: str, units: str, replicates: int, seed: int = 7) -> str:
    """Draws (b, unit) of the different units of a table, as :func:`heronry.operators.stats.draws` makes them."""
    return f"""{name}_u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS k FROM (SELECT DISTINCT unit FROM {units})), {name}_n AS (SELECT count(*) AS n FROM {name}_u),
{name}_k AS (SELECT b, floor(('0x' || substr(md5('{seed}:' || b || ':' || j), 1, 12))::BIGINT / 281474976710656.0 * n)::BIGINT AS k FROM (SELECT b, unnest(range(0, n)) AS j, n FROM {name}_n, (SELECT unnest(range(0, {replicates})) AS b))), {name} AS (SELECT b, unit FROM {name}_k JOIN {name}_u USING (k))"""


@query(f"""WITH {D_SQL}, {draw_sql('dw', 'dd', BOOT)}, st AS (SELECT b, op, am, avg(v) AS m FROM dw JOIN dd USING (unit) GROUP BY ALL)
SELECT op, am, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(m) AS n_rep FROM st GROUP BY ALL""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of mean effects, units resampled once for all cells."""
    e = _effects(spark, d)
    return T.bootstrap(e, T.draws(spark, e, BOOT), ["op", "am"], F.avg("v")).select("op", "am", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n_rep")


@query(f"""WITH {D_SQL}, ga AS (SELECT * FROM dd WHERE op = 'A'), gr AS (SELECT * FROM dd WHERE op = 'R'), {draw_sql('da', 'ga', BOOT)}, {draw_sql('dr', 'gr', BOOT, 8)}, sa AS (SELECT b, avg(v) AS m FROM da JOIN ga USING (unit) GROUP BY b), sr AS (SELECT b, avg(v) AS m FROM dr JOIN gr USING (unit) GROUP BY b), st AS (SELECT sa.m - sr.m AS m FROM sa JOIN sr USING (b))
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(m) AS n_rep FROM st""")
def stratified_diff(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference between two groups, each resampled within itself."""
    e = _effects(spark, d)
    mean = lambda op, seed, name: T.draws(spark, e.where(F.col("op") == op), BOOT, seed=seed).join(e.where(F.col("op") == op), "unit").groupBy("b").agg(F.avg("v").alias(name))
    reps = mean("A", 7, "a").join(mean("R", 8, "r"), "b").select((F.col("a") - F.col("r")).alias("m"))
    return reps.agg(r6(F.percentile("m", F.lit(0.025))).alias("lo"), r6(F.percentile("m", F.lit(0.975))).alias("hi"), F.count("m").alias("n_rep"))


@query("""WITH st AS (SELECT c_nationkey::VARCHAR AS stratum, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT *, 60.0 * n / sum(n) OVER () AS q FROM st), f AS (SELECT *, floor(q) AS f, floor(q) = 0 AS raised, greatest(floor(q), 1) AS s FROM q), g AS (SELECT *, 60 - sum(s) OVER () AS lft, NOT raised AND s < n AS op FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY q - f DESC, n DESC, stratum) AS rn FROM g) SELECT stratum, n, (s + CASE WHEN op AND rn <= lft THEN 1 ELSE 0 END)::BIGINT AS seats FROM h""")
def stratified_alloc(spark: SparkSession, d: str) -> DataFrame:
    st = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return T.allocate(st, 60).select("stratum", "n", "seats")


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY ('0x' || substr(md5('7:' || c_custkey), 1, 12))::BIGINT, c_custkey) AS r FROM customer) SELECT c_custkey, c_nationkey FROM r WHERE r <= 2""")
def random_members(spark: SparkSession, d: str) -> DataFrame:
    """Two random members of each group: the feature is the sample."""
    return T.pick(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 2, key="c_custkey")


LOC_SQL = "pl AS (SELECT series_id, idx, x AS r, (event_type = 'error')::INT AS y FROM s)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return A.series(spark, d).select("series_id", "idx", F.col("x").alias("r"), (F.col("event_type") == "error").cast("int").alias("y"))


@query(f"""WITH {A.S_SQL}, {LOC_SQL}, b AS (SELECT series_id, min(idx) FILTER (WHERE y = 1) - 5 AS lo, max(idx) FILTER (WHERE y = 1) + 6 AS hi, sum(r) AS tot FROM pl GROUP BY 1), j AS (SELECT pl.*, lo, hi, CASE WHEN tot > 0 THEN r ELSE 1.0 END AS v FROM pl JOIN b USING (series_id))
SELECT series_id, round(sum(CASE WHEN y = 1 THEN v ELSE 0 END) / sum(v), 6) AS lp, round(sum(CASE WHEN y = 1 THEN v ELSE 0 END) / sum(v) / nullif(avg(y), 0), 6) AS lift, round(sum(CASE WHEN idx >= lo AND idx < hi THEN v ELSE 0 END) / sum(v), 6) AS lp_tolerant FROM j GROUP BY 1""")
def localization(spark: SparkSession, d: str) -> DataFrame:
    return X.localization(_labelled(spark, d), tolerance=5).select("series_id", *[r6(F.col(c)).alias(c) for c in ("lp", "lift", "lp_tolerant")])


@query(f"""WITH {A.S_SQL}, {LOC_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY r) + (count(*) OVER (PARTITION BY series_id, r) - 1) / 2.0 AS rk, sum(y) OVER w AS tp, count(*) OVER w AS n FROM pl WINDOW w AS (PARTITION BY series_id ORDER BY r DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT series_id, sum(rk) FILTER (WHERE y = 1) AS rs, sum(y)::DOUBLE AS np, count(*) - sum(y)::DOUBLE AS nn, sum(tp / n::DOUBLE) FILTER (WHERE y = 1) AS ap FROM k GROUP BY 1)
SELECT series_id, round(CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2) / (np * nn) END, 6) AS auroc, round(CASE WHEN np > 0 AND nn > 0 THEN ap / np END, 6) AS ap FROM g""")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return X.auroc(_labelled(spark, d), score="r").select("series_id", r6(F.col("auroc")).alias("auroc"), r6(F.col("ap")).alias("ap"))


@query(f"""WITH {A.S_SQL}, {LOC_SQL}, v AS (SELECT *, r - 30 AS raw, greatest(r - 30, 0) AS v, sum(y) OVER (PARTITION BY series_id) AS gt, row_number() OVER (PARTITION BY series_id ORDER BY greatest(r - 30, 0) DESC, idx) AS rn FROM pl),
g AS (SELECT series_id, sum(v) AS mass, sum(v * y) AS onn, sum(y) FILTER (WHERE rn <= gt) AS top, max(gt)::DOUBLE AS gt, count(*) AS n, sum(CASE WHEN raw < 0 THEN -raw ELSE 0 END) AS neg, sum(abs(raw)) AS al FROM v GROUP BY 1), h AS (SELECT *, gt / n AS chance, CASE WHEN mass > 0 THEN onn / mass END AS rma, top / nullif(gt, 0) AS rra FROM g)
SELECT series_id, round(rma, 6) AS rma, round(rra, 6) AS rra, round(chance, 6) AS chance, round((rma - chance) / (1 - chance), 6) AS rma_norm, round((rra - chance) / (1 - chance), 6) AS rra_norm, round(neg / nullif(al, 0), 6) AS neg_mass FROM h""")
def rma_rra(spark: SparkSession, d: str) -> DataFrame:
    p = _labelled(spark, d).select("series_id", "idx", (F.col("r") - 30).alias("v"), "y", F.col("idx").alias("tie"))
    return X.plausibility(p).select("series_id", *[r6(F.col(c)).alias(c) for c in ("rma", "rra", "chance", "rma_norm", "rra_norm", "neg_mass")])


@query(f"""WITH {A.S_SQL}, v AS (SELECT series_id, idx, ('0x' || substr(md5('7:' || series_id || ':' || idx), 1, 12))::BIGINT / 281474976710656.0 AS rnd, abs((x - avg(x) OVER p) / nullif(stddev_pop(x) OVER p, 0)) AS z, pow(x - sum(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 2) AS res FROM s WINDOW p AS (PARTITION BY series_id))
SELECT series_id, idx, round(rnd / sum(rnd) OVER q, 6) AS random, round(1.0 / count(*) OVER q, 6) AS uniform, round(z / sum(z) OVER q, 6) AS abs_z, round(res / sum(res) OVER q, 6) AS residual FROM v WINDOW q AS (PARTITION BY series_id)""")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    return X.baselines(A.series(spark, d)).select("series_id", "idx", *[r6(F.col(c)).alias(c) for c in ("random", "uniform", "abs_z", "residual")])


SEG_SQL = """om AS (SELECT series_id, greatest(s0 - w + 1, te) AS lo, least(s1 + w - 1, n) AS hi FROM l), sg AS (SELECT series_id, seg, lo + seg AS a, lo + seg + 1 AS b FROM (SELECT *, unnest(range(0, hi - lo)) AS seg FROM om))"""


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {SEG_SQL}, att AS (SELECT sg.series_id, seg, round(x, 3) AS value FROM sg JOIN s ON s.series_id = sg.series_id AND idx = a), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, seg) AS rn, count(*) OVER (PARTITION BY series_id) AS k FROM att),
c AS (SELECT *, unnest(range(1, 11)) AS step FROM o) SELECT series_id, step::INT AS step, count(*) AS masked, round(sum(value), 6) AS gone FROM c WHERE rn <= ceil(step * k / 10.0) GROUP BY ALL""")
def masking_curve(spark: SparkSession, d: str) -> DataFrame:
    """How many segments each step masks, most relevant first, and the value they hold."""
    segs = S.segments(A.layouts(spark, d))
    at = segs.join(A.series(spark, d).select("series_id", F.col("idx").alias("a"), "x"), ["series_id", "a"]).select("series_id", "seg", F.round("x", 3).alias("value"), F.col("seg").alias("tie"))
    order = X.order_segments(at)
    return X.curve(order).join(at, ["series_id", "seg"]).groupBy("series_id", "step").agg(F.count(F.lit(1)).alias("masked"), r6(F.sum("value")).alias("gone"))


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {SEG_SQL}, f AS (SELECT series_id, max(x) AS f0 FROM s JOIN sg USING (series_id) WHERE idx = a GROUP BY 1), g AS (SELECT k.series_id, k.seg, max(CASE WHEN sg.seg = k.seg THEN 0.0 ELSE x END) AS f FROM sg k JOIN sg USING (series_id) JOIN s ON s.series_id = k.series_id AND s.idx = sg.a GROUP BY ALL)
SELECT series_id, seg, round(f0 - f, 6) AS value FROM g JOIN f USING (series_id)""")
def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    """What the interval's largest value loses when one segment is zeroed."""
    segs = S.segments(A.layouts(spark, d))
    inside = segs.join(A.series(spark, d), "series_id").where("idx >= a AND idx < b").select("series_id", "seg", "idx", "x")
    f0 = inside.groupBy("series_id").agg(F.max("x").alias("f0"))
    masked = segs.select("series_id", F.col("seg").alias("k")).join(inside, "series_id").groupBy("series_id", F.col("k").alias("seg")).agg(F.max(F.when(F.col("seg") == F.col("k"), 0.0).otherwise(F.col("x"))).alias("f"))
    return X.ablation(f0, masked).select("series_id", "seg", r6(F.col("value")).alias("value"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {SEG_SQL} SELECT sg.series_id, seg::BIGINT AS seg, round(sum(x), 4) AS value FROM sg JOIN s ON s.series_id = sg.series_id AND idx >= a AND idx < b GROUP BY ALL")
def kernel_shap(spark: SparkSession, d: str) -> DataFrame:
    """Shapley values of a sum over segments, which are the segments' own values."""
    segs = S.segments(A.layouts(spark, d))
    val = segs.join(A.series(spark, d), "series_id").where("idx >= a AND idx < b").groupBy("series_id", "seg").agg(F.sum("x").alias("v"))
    packed = val.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "v"))), lambda p: p["v"]).alias("v"), F.count(F.lit(1)).alias("k"))
    z = X.coalitions(packed.select("series_id", "k"), 2 * F.col("k") + 2048)
    f = X.merged(z).join(packed, "series_id").withColumn("f", F.aggregate(F.zip_with("z", "v", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q))
    return X.kernel_shap(f.select("series_id", "z", "weight", "f")).select("series_id", "seg", F.round("value", 4).alias("value"))


@query("""WITH v AS (SELECT o_custkey % 7 AS k, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS d FROM orders), z AS (SELECT k, d, abs(d) AS ad FROM v WHERE d IS NOT NULL AND d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY ad) + (count(*) OVER (PARTITION BY k, ad) - 1) / 2.0 AS rk FROM z)
SELECT k, count(*)::DOUBLE AS n, round(sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE, 6) AS w_plus, round(sum(CASE WHEN d < 0 THEN rk ELSE 0 END)::DOUBLE, 6) AS w_minus FROM r GROUP BY k""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank sums of changes between a customer's orders; p has an approximation of its own, in the tests."""
    v = table(spark, d, "orders").withColumn("d", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), 6)).where("d IS NOT NULL").select((F.col("o_custkey") % 7).alias("k"), "d")
    return T.wilcoxon(v, ["k"]).select("k", "n", r6(F.col("w_plus")).alias("w_plus"), r6(F.col("w_minus")).alias("w_minus"))


# --- reports


@query("""WITH p AS (SELECT l_suppkey, l_partkey % 4 AS reg, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
SELECT reg, count(*) AS n, round(median(a), 6) AS med_a, round(median(r), 6) AS med_r, round(median(a - r), 6) AS med_diff, round(avg((round(a, 9) < round(r, 9))::INT), 6) AS share_smaller FROM p WHERE a IS NOT NULL AND r IS NOT NULL GROUP BY reg""")
def paired_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Two operators on the same keys, incomplete pairs dropped."""
    avg = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount")))
    p = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 4).alias("reg")).agg(avg("A").alias("a"), avg("R").alias("r")).where("a IS NOT NULL AND r IS NOT NULL")
    return p.groupBy("reg").agg(F.count(F.lit(1)).alias("n"), r6(F.median("a")).alias("med_a"), r6(F.median("r")).alias("med_r"), r6(F.median(F.col("a") - F.col("r"))).alias("med_diff"), r6(F.avg((F.round("a", 9) < F.round("r", 9)).cast("int"))).alias("share_smaller"))


@query(f"WITH {D_SQL} SELECT x.op, x.am AS am_a, y.am AS am_b, count(*) AS n, round(median(x.v - y.v), 6) AS med_diff FROM dd x JOIN dd y ON x.unit = y.unit AND x.op = y.op AND x.am < y.am GROUP BY ALL")
def am_pair_tests(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of methods within an operator."""
    a, b = (_effects(spark, d).select("unit", "op", F.col("am").alias(f"am_{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    return a.join(b, ["unit", "op"]).where("am_a < am_b").groupBy("op", "am_a", "am_b").agg(F.count(F.lit(1)).alias("n"), r6(F.median(F.col("va") - F.col("vb"))).alias("med_diff"))


@query(f"""WITH {D_SQL}, df AS (SELECT x.op, x.am || ' - ' || y.am AS test, round(x.v - y.v, 9) AS d FROM dd x JOIN dd y ON x.unit = y.unit AND x.op = y.op AND x.am < y.am WHERE x.v IS NOT NULL AND y.v IS NOT NULL),
z AS (SELECT op, test, d, abs(d) AS ad FROM df WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY op, test ORDER BY ad) + (count(*) OVER (PARTITION BY op, test, ad) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY op, test, ad) AS t FROM z),
s AS (SELECT op, test, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END)::DOUBLE AS wm, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY ALL),
zz AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s), tt AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM zz),
tl AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS tail FROM tt),
ps AS (SELECT op, test, n, least(1.0, 2 * CASE WHEN z < 0 THEN tail ELSE 1 - tail END) AS p FROM tl), me AS (SELECT op, test, median(d) AS med FROM df GROUP BY ALL),
ai AS (SELECT me.op, me.test, med, coalesce(n, 0) AS n, coalesce(p, 1.0) AS p FROM me LEFT JOIN ps ON ps.op = me.op AND ps.test = me.test), st AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY p, test) AS i, count(*) OVER (PARTITION BY op) AS k FROM ai)
SELECT op, test, round(med, 6) AS med, n, round(p, 6) AS p, round(least(1.0, max((k - i + 1) * p) OVER (PARTITION BY op ORDER BY i)), 6) AS p_holm FROM st""")
def am_pair_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank tests of all pairs of methods within an operator, adjusted step by step."""
    a, b = (_effects(spark, d).where("v IS NOT NULL").select("unit", "op", F.col("am").alias(f"am_{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    pairs = a.join(b, ["unit", "op"]).where("am_a < am_b").select("op", F.concat("am_a", F.lit(" - "), "am_b").alias("test"), F.round(F.col("va") - F.col("vb"), 9).alias("d"))
    tests = T.holm(T.wilcoxon(pairs, ["op", "test"]), ["op"])
    middle = pairs.groupBy("op", "test").agg(F.median("d").alias("med"))
    return tests.join(middle, ["op", "test"]).select("op", "test", r6(F.col("med")).alias("med"), "n", r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"))


@query("""SELECT coalesce(l_returnflag, 'all') AS op, coalesce(l_linenumber::VARCHAR, 'all') AS len, count(*) AS n, round(quantile_cont(CASE WHEN l_tax > 0.04 THEN l_discount END, 0.5), 6) AS med_fa, round(quantile_cont(CASE WHEN l_tax <= 0.04 THEN l_discount END, 0.5), 6) AS med_other FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)""")
def fa_ai_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Effects of false alarms and others by operator and length, with subtotals."""
    hi = F.col("l_tax") > 0.04
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), r6(F.percentile(F.when(hi, F.col("l_discount")), F.lit(0.5))).alias("med_fa"), r6(F.percentile(F.when(~hi, F.col("l_discount")), F.lit(0.5))).alias("med_other"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("op"), F.coalesce(F.col("l_linenumber").cast("string"), F.lit("all")).alias("len"), "n", "med_fa", "med_other")


@query("""WITH c AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT coalesce(size::VARCHAR, 'total') AS size, count(*) AS n_groups, sum(size)::BIGINT AS n_members FROM c GROUP BY ROLLUP (size)""")
def group_size_dist(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size")).withColumn("members", F.col("size"))
    return c.rollup("size").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("members").alias("n_members")).select(F.coalesce(F.col("size").cast("string"), F.lit("total")).alias("size"), "n_groups", "n_members")


@query("""WITH s AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS al, bool_or(o_orderstatus = 'F') AS an FROM orders GROUP BY 1) SELECT CASE WHEN al THEN 'all' WHEN NOT an THEN 'none' ELSE 'mixed' END AS agreement, count(*) AS n FROM s GROUP BY 1""")
def seed_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Units on which all, none or some of the repeated runs agree."""
    f = F.col("o_orderstatus") == "F"
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(f).alias("al"), F.bool_or(f).alias("an"))
    return s.groupBy(F.when(F.col("al"), "all").when(~F.col("an"), "none").otherwise("mixed").alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderstatus) AS x FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN substr(c_mktsegment, 1, 1) END AS y FROM customer) SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' WHEN x IS NULL OR y IS NULL THEN 'unknown' WHEN x = y THEN 'equal' ELSE 'differ' END AS verdict, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1""")
def domain_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of a label compared by key, keys of one side only included."""
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("x")).withColumn("l", F.lit(1))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 9 != 0, F.substring("c_mktsegment", 1, 1)).alias("y"), F.lit(1).alias("r"))
    v = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(F.col("x").isNull() | F.col("y").isNull(), "unknown").when(F.col("x") == F.col("y"), "equal").otherwise("differ")
    return a.join(b, "k", "full").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT l_suppkey, l_discount, count(*) AS c FROM lineitem GROUP BY ALL), k AS (SELECT l_suppkey, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)::DOUBLE AS tied FROM t GROUP BY 1) SELECT round(avg((tied > 0)::INT), 6) AS share, round(median(tied), 6) AS med, round(quantile_cont(tied, 0.75) - quantile_cont(tied, 0.25), 6) AS iqr, round(max(tied), 6) AS most FROM k""")
def tie_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_suppkey", "l_discount").agg(F.count(F.lit(1)).alias("c"))
    k = t.groupBy("l_suppkey").agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("tied"))
    return k.agg(r6(F.avg((F.col("tied") > 0).cast("int"))).alias("share"), r6(F.median("tied")).alias("med"), r6(F.percentile("tied", F.lit(0.75)) - F.percentile("tied", F.lit(0.25))).alias("iqr"), r6(F.max("tied")).alias("most"))


@query("""WITH a AS (SELECT user_id AS num, count_if(event_type = 'error') > 4 AS x FROM events GROUP BY 1), b AS (SELECT user_id AS num, count_if(event_type = 'click') > 12 AS y FROM events GROUP BY 1) SELECT CASE WHEN x AND y THEN 'both' WHEN x THEN 'only_a' WHEN y THEN 'only_b' ELSE 'neither' END AS cell, count(*) AS n FROM a JOIN b USING (num) GROUP BY 1""")
def paired_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Two conditions on the same series: both, one or neither detects."""
    e = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") > 4).alias("x"), (F.count_if(F.col("event_type") == "click") > 12).alias("y"))
    return e.groupBy(F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), "only_a").when(F.col("y"), "only_b").otherwise("neither").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
