"""Queries: detection, masking, perturbation, entity grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import numeric as N
from heronry.operators import entity as E
from heronry.operators import masking as M
from heronry.operators import metrics as X
from heronry.operators import profile as P
from heronry.operators import series as S
from heronry.plans import adapters as A
from heronry.plans.registry import query, table

r6 = N.r6

# windows of 6 points, z-normalised; constant ones become zeros
WIN_SQL = """wn AS (SELECT series_id, start, v, list_max(v) = list_min(v) AS flat, list_avg(v) AS mu, list_stddev_pop(v) AS sd FROM
  (SELECT series_id, idx AS start, list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS v FROM s) WHERE len(v) = 6),
zw AS (SELECT series_id, start, v, flat, CASE WHEN flat THEN [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] ELSE list_transform(v, lambda y: (y - mu) / sd) END AS z FROM wn)"""
DIST = "CASE WHEN q.flat AND f.flat THEN 0.0 WHEN q.flat OR f.flat THEN sqrt(6.0) ELSE list_distance(q.z, f.z) END"
PROFILE_SQL = f"p AS (SELECT q.series_id, q.start, min({DIST}) AS dist FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE f.start + 6 <= l.te GROUP BY ALL)"
PAD_SQL = """lo AS (SELECT series_id, min(dist) AS least FROM p GROUP BY 1),
sc AS (SELECT s.series_id, s.idx, coalesce(p.dist, lo.least) AS score FROM s JOIN lo USING (series_id) LEFT JOIN p ON p.series_id = s.series_id AND p.start + 3 = s.idx)"""
DETECT_SQL = """dt AS (SELECT series_id, n, te, s0, s1, w,
  max(score) FILTER (WHERE idx >= s0 AND idx < s1) AS max_anom,
  quantile_cont(score, 0.99) FILTER (WHERE idx >= te AND NOT (idx >= s0 AND idx < s1)) AS thr_b0,
  quantile_cont(score, 0.99) FILTER (WHERE idx >= te AND NOT (idx >= s0 - w AND idx < s1 + w)) AS thr_bw,
  median(score) FILTER (WHERE idx >= te AND NOT (idx >= s0 - w AND idx < s1 + w)) AS med_bw,
  arg_min(idx, {'a': -score, 'b': idx}) FILTER (WHERE idx >= te) AS argmax0
  FROM sc JOIN l USING (series_id) GROUP BY ALL)"""
DETECTION = f"WITH {A.S_SQL}, {A.L_SQL}, {WIN_SQL}, {PROFILE_SQL}, {PAD_SQL}, {DETECT_SQL}"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    lay = A.layouts(spark, d)
    return P.pad(P.matrix_profile(A.series(spark, d), lay), lay)


def _detection(spark: SparkSession, d: str) -> DataFrame:
    return P.detection(_scores(spark, d), A.layouts(spark, d))


@query(f"""{DETECTION} SELECT series_id, round(max_anom, 6) AS max_anom, round(thr_b0, 6) AS thr_b0, round(thr_bw, 6) AS thr_bw, max_anom > thr_b0 AS p1_b0, max_anom > thr_bw AS p1_bw, argmax0,
 argmax0 + 1 > least(s0 + 1 - (s1 - s0), s0 + 1 - 100) AND argmax0 + 1 < greatest(s1 + (s1 - s0), s1 + 100) AS p2_archive, argmax0 >= s0 - 100 AND argmax0 < s1 + 100 AS p2_brief,
 round(CASE WHEN thr_bw - med_bw > 0 THEN thr_bw - med_bw END, 6) AS scale FROM dt""")
def gate_detection(spark: SparkSession, d: str) -> DataFrame:
    """Which series a matrix profile detects, under two thresholds and two position rules."""
    return _detection(spark, d).select("series_id", *[r6(F.col(c)).alias(c) for c in ("max_anom", "thr_b0", "thr_bw")], "p1_b0", "p1_bw", "argmax0", "p2_archive", "p2_brief", r6(F.col("scale")).alias("scale"))


@query(f"""{DETECTION}, {A.META_SQL}, g AS (SELECT domain, name_group, avg((max_anom > thr_bw)::INT) AS rate, count(*) AS n FROM dt JOIN meta ON num = series_id GROUP BY ALL)
SELECT domain, sum(n)::BIGINT AS n_series, count(*)::BIGINT AS n_groups, round(avg(rate), 6) AS group_rate FROM g GROUP BY domain""")
def gate_rate_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Detection rate by domain: a mean within groups, then over groups."""
    j = _detection(spark, d).join(A.meta(spark, d), F.col("num") == F.col("series_id"))
    g = j.groupBy("domain", "name_group").agg(F.avg(F.col("p1_bw").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("domain").agg(F.sum("n").alias("n_series"), F.count(F.lit(1)).alias("n_groups"), r6(F.avg("rate")).alias("group_rate"))


SELF_SQL = f"p AS (SELECT q.series_id, q.start, min({DIST}) AS dist FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE abs(q.start - f.start) > 2 GROUP BY ALL)"


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {WIN_SQL}, {SELF_SQL} SELECT series_id, start, round(dist, 6) AS dist FROM p")
def self_join_mp(spark: SparkSession, d: str) -> DataFrame:
    return P.matrix_profile(A.series(spark, d), A.layouts(spark, d), mode="self_join").select("series_id", "start", r6(F.col("dist")).alias("dist"))


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {WIN_SQL} SELECT q.series_id, q.start, round(min(list_distance(q.v, f.v)), 6) AS dist FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE f.start + 6 <= l.te GROUP BY ALL""")
def aamp(spark: SparkSession, d: str) -> DataFrame:
    """The same join of plain windows."""
    return P.matrix_profile(A.series(spark, d), A.layouts(spark, d), kind="raw").select("series_id", "start", r6(F.col("dist")).alias("dist"))


@query(f"""{DETECTION}, s2 AS (SELECT s.series_id, s.idx, CASE WHEN idx >= te + 12 AND idx < te + 15 THEN 0.0 ELSE x END AS x FROM s JOIN l USING (series_id) WHERE te + 15 <= n),
wn2 AS (SELECT series_id, start, list_max(v) = list_min(v) AS flat, list_avg(v) AS mu, list_stddev_pop(v) AS sd, v FROM (SELECT series_id, idx AS start, list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS v FROM s2) WHERE len(v) = 6),
zw2 AS (SELECT series_id, start, flat, CASE WHEN flat THEN [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] ELSE list_transform(v, lambda y: (y - mu) / sd) END AS z FROM wn2)
SELECT q.series_id, q.start, round(min({DIST}), 6) AS dist FROM zw2 q JOIN zw2 f USING (series_id) JOIN l USING (series_id) WHERE f.start + 6 <= l.te GROUP BY ALL""")
def incremental_mp(spark: SparkSession, d: str) -> DataFrame:
    """The profile after a region is zeroed: windows that meet it anew, the rest from the profile before."""
    reg = A.regions(spark, d)
    series = A.series(spark, d)
    base = P.matrix_profile(series, reg)
    changed = M.mask(A.points(spark, d), "zero").select("series_id", "idx", F.col("masked").alias("x"))
    return P.incremental(base, series, changed, reg).select("series_id", "start", r6(F.col("dist")).alias("dist"))


@query(f"""{DETECTION}, sv AS (SELECT dt.*, z.zmax FROM dt JOIN (SELECT series_id, arg_min(idx, {{'a': -round(abs((x - mu) / sd), 9), 'b': idx}}) AS zmax FROM (SELECT s.series_id, s.idx, s.x, avg(x) FILTER (WHERE idx < te) OVER w AS mu, nullif(stddev_pop(x) FILTER (WHERE idx < te) OVER w, 0) AS sd, te FROM s JOIN l USING (series_id) WINDOW w AS (PARTITION BY s.series_id)) WHERE idx >= te GROUP BY 1) z USING (series_id))
SELECT series_id, CASE WHEN NOT (argmax0 >= s0 - 10 AND argmax0 < s1 + 10) THEN 'impossible' WHEN zmax >= s0 - 10 AND zmax < s1 + 10 THEN 'trivial' ELSE 'keep' END AS verdict FROM sv""")
def difficulty_screen(spark: SparkSession, d: str) -> DataFrame:
    """Impossible where the detector's peak misses, trivial where the peak of |z| hits as well."""
    w = Window.partitionBy("series_id")
    tr = F.when(F.col("idx") < F.col("te"), F.col("x"))
    z = A.series(spark, d).join(A.layouts(spark, d), "series_id").withColumn("z", F.abs((F.col("x") - F.avg(tr).over(w)) / F.nullif(F.stddev_pop(tr).over(w), F.lit(0.0)))).where("idx >= te")
    z = z.groupBy("series_id").agg(F.min_by("idx", F.struct(-F.round("z", 9), F.col("idx"))).alias("zmax"))
    hit = lambda c: (F.col(c) >= F.col("s0") - 10) & (F.col(c) < F.col("s1") + 10)
    return _detection(spark, d).join(z, "series_id").select("series_id", F.when(~hit("argmax0"), "impossible").when(hit("zmax"), "trivial").otherwise("keep").alias("verdict"))


FA_SQL = f"""{DETECTION}, pos AS (SELECT p.series_id, p.start % 4 AS k, p.dist AS before, raw.dist AS after, thr_b0 AS thr FROM p JOIN (SELECT q.series_id, q.start, min(list_distance(q.v, f.v)) / 10 AS dist FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE f.start + 6 <= l.te GROUP BY ALL) raw USING (series_id, start) JOIN dt USING (series_id)),
fa AS (SELECT k, count(*) AS n, count_if(before > thr) AS pre, count_if(before <= thr AND after > thr) AS fa FROM pos GROUP BY k)"""


@query(f"{FA_SQL} SELECT k, n, pre, fa, n - pre AS remaining, round(CASE WHEN n - pre >= 10 THEN fa / (n - pre)::DOUBLE END, 6) AS rate FROM fa")
def false_alarm(spark: SparkSession, d: str) -> DataFrame:
    """New alarms by cell among positions without one before."""
    lay = A.layouts(spark, d)
    s = A.series(spark, d)
    before = P.matrix_profile(s, lay).select("series_id", "start", F.col("dist").alias("before"))
    after = P.matrix_profile(s, lay, kind="raw").select("series_id", "start", (F.col("dist") / 10).alias("after"))
    thr = _detection(spark, d).select("series_id", F.col("thr_b0").alias("thr"))
    pos = before.join(after, ["series_id", "start"]).join(thr, "series_id").withColumn("k", F.col("start") % 4)
    return X.false_alarms(pos, ["k"]).select("k", "n", "pre", "fa", "remaining", r6(F.col("rate")).alias("rate"))


# --- masking

PT_SQL = f"WITH {A.S_SQL}, {A.L_SQL}, {A.R_SQL}, q AS (SELECT s.series_id, s.idx, s.x, r.n, r.te, r.s0, r.s1, r.w, r.a, r.b FROM s JOIN r USING (series_id))"

#: Operators whose values are the same in every SQL engine to six places.
DETERMINISTIC = ("identity", "zero", "global_mean", "local_mean", "linear", "z_zero", "out_of_dist_high", "inverse", "noise100", "gaussian")


@query(f"""{PT_SQL}, v AS (SELECT *, avg(x) OVER w_ AS mean, stddev_pop(x) OVER w_ AS spread, avg(CASE WHEN idx < te THEN x END) OVER w_ AS mu, stddev_pop(CASE WHEN idx < te THEN x END) OVER w_ AS sd, max(x) OVER w_ AS top,
 avg(CASE WHEN (idx >= a - 50 AND idx < a) OR (idx >= b AND idx < b + 50) THEN x END) OVER w_ AS near, max(CASE WHEN idx = a - 1 THEN x END) OVER w_ AS lf, max(CASE WHEN idx = b THEN x END) OVER w_ AS rt FROM q WINDOW w_ AS (PARTITION BY series_id)),
u AS (SELECT *, CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS sdd, coalesce(lf, rt) AS f_, coalesce(rt, lf) AS g_, ('0x' || substr(md5('7:' || series_id || ':' || idx || ':u'), 1, 12))::BIGINT / 281474976710656.0 AS u1, ('0x' || substr(md5('7:' || series_id || ':' || idx || ':v'), 1, 12))::BIGINT / 281474976710656.0 AS u2, ('0x' || substr(md5('7:' || series_id || ':' || idx || ':n'), 1, 12))::BIGINT / 281474976710656.0 AS u3 FROM v),
h AS (SELECT *, max(abs((x - mu) / sdd)) OVER (PARTITION BY series_id) AS hi FROM u),
o AS (SELECT series_id, idx, x, idx >= a AND idx < b AS m, unnest([{{'op': 'identity', 'y': x}}, {{'op': 'zero', 'y': 0.0}}, {{'op': 'global_mean', 'y': mean}}, {{'op': 'local_mean', 'y': coalesce(near, mean)}}, {{'op': 'linear', 'y': coalesce(f_ + (g_ - f_) * (idx - a + 1) / (b - a + 1)::DOUBLE, mean)}},
 {{'op': 'z_zero', 'y': mu}}, {{'op': 'out_of_dist_high', 'y': 100 * hi * sdd + mu}}, {{'op': 'inverse', 'y': top - x + mu}}, {{'op': 'noise100', 'y': (u3 * 200 - 100) * sdd + mu}}, {{'op': 'gaussian', 'y': mean + (CASE WHEN spread > 0 THEN spread ELSE 1e-8 END) * sqrt(-2 * ln(1 - u1)) * cos(6.283185307179586 * u2)}}]) AS t FROM h)
SELECT series_id, idx, t.op AS op, round(CASE WHEN m THEN t.y ELSE x END, 9) AS masked FROM o""")
def mask_operators(spark: SparkSession, d: str) -> DataFrame:
    """All pointwise masking operators on one region a series."""
    return M.mask_all(A.points(spark, d), DETERMINISTIC).select("series_id", "idx", "op", F.round("masked", 9).alias("masked"))


@query(f"""{PT_SQL}, hs AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS k, row_number() OVER (PARTITION BY series_id ORDER BY ('0x' || substr(md5('7:' || series_id || ':' || idx), 1, 12))::BIGINT, idx) AS rr FROM q WHERE idx >= a AND idx < b)
SELECT p.series_id, p.idx, round(v.x, 6) AS masked FROM hs p JOIN hs v ON p.series_id = v.series_id AND p.k = v.rr""")
def mask_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return M.shuffle_inside(A.points(spark, d)).where(M.inside()).select("series_id", "idx", r6(F.col("masked")).alias("masked"))


@query(f"""{PT_SQL}, f AS (SELECT *, idx - a AS t, b - a AS rr FROM q WHERE idx >= a AND idx < b)
SELECT f.series_id, f.idx, round(v.x, 6) AS masked FROM f LEFT JOIN s v ON v.series_id = f.series_id AND v.idx = CASE WHEN a = 0 THEN b + t WHEN b > n - rr THEN a - rr + t WHEN t < ceil(rr / 2.0) THEN a - ceil(rr / 2.0)::BIGINT + t ELSE b + t - ceil(rr / 2.0)::BIGINT END""")
def mask_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return M.neighbour_window(A.points(spark, d)).where(M.inside()).select("series_id", "idx", r6(F.col("masked")).alias("masked"))


def _donor_sql(low: str, high: str) -> str:
    return f"""{PT_SQL}, c AS (SELECT *, unnest(range(greatest({low}, 1), least({high}, n - 1) - 3 + 1)) AS u FROM r WHERE a >= 1 AND b + 1 <= n),
ok AS (SELECT * FROM c WHERE NOT (u < s1 + w AND u + 3 > s0 - w) AND NOT (u < b + w - 1 AND u + 3 > a - w + 1) AND NOT (u < a AND u + 3 > a - 1) AND NOT (u < b + 1 AND u + 3 > b)),
ds AS (SELECT ok.series_id, u, a, b, round((x1.x - y1.x) * (x1.x - y1.x) + (x2.x - y2.x) * (x2.x - y2.x), 9) AS dd FROM ok JOIN s x1 ON x1.series_id = ok.series_id AND x1.idx = u - 1 JOIN s y1 ON y1.series_id = ok.series_id AND y1.idx = a - 1 JOIN s x2 ON x2.series_id = ok.series_id AND x2.idx = u + 3 JOIN s y2 ON y2.series_id = ok.series_id AND y2.idx = b),
best AS (SELECT series_id, arg_min(u, {{'a': dd, 'b': u}}) AS u FROM ds GROUP BY 1)
SELECT q.series_id, q.idx, round(v.x, 6) AS masked FROM q LEFT JOIN best USING (series_id) LEFT JOIN s v ON v.series_id = q.series_id AND v.idx = best.u + q.idx - q.a WHERE q.idx >= a AND q.idx < b"""


@query(_donor_sql("te", "n"))
def recon_test(spark: SparkSession, d: str) -> DataFrame:
    """The region copied from the stretch of the test part whose surroundings are nearest."""
    return M.reconstruct(A.points(spark, d), where="test").where(M.inside()).select("series_id", "idx", r6(F.col("masked")).alias("masked"))


@query(_donor_sql("0", "te"))
def recon_train(spark: SparkSession, d: str) -> DataFrame:
    return M.reconstruct(A.points(spark, d), where="train").where(M.inside()).select("series_id", "idx", r6(F.col("masked")).alias("masked"))


@query(f"""{PT_SQL}, {WIN_SQL}, dd AS (SELECT r.series_id, f.start AS j, round(CASE WHEN qq.flat AND f.flat THEN 0 WHEN qq.flat OR f.flat THEN 6 ELSE list_distance(qq.z, f.z) * list_distance(qq.z, f.z) END, 9) AS dd FROM r JOIN zw qq ON qq.series_id = r.series_id AND qq.start = r.a - 6 JOIN zw f ON f.series_id = r.series_id AND f.start + 6 + r.b - r.a <= r.te),
best AS (SELECT series_id, arg_min(j, {{'a': dd, 'b': j}}) AS j FROM dd GROUP BY 1)
SELECT q.series_id, q.idx, round(v.x + e.x - t.x, 6) AS masked FROM q JOIN best USING (series_id) JOIN s v ON v.series_id = q.series_id AND v.idx = j + 6 + q.idx - q.a JOIN s e ON e.series_id = q.series_id AND e.idx = q.a - 1 JOIN s t ON t.series_id = q.series_id AND t.idx = j + 5 WHERE q.idx >= a AND q.idx < b""")
def context_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    return M.context_reconstruct(A.points(spark, d)).where(M.inside()).select("series_id", "idx", r6(F.col("masked")).alias("masked"))


# --- perturbation effects: orders as effects of operators (return flags) on series (suppliers)

AI_SQL = "ai AS (SELECT l_suppkey AS series_id, l_returnflag AS op, CASE WHEN l_linenumber = 1 THEN 'anomaly' ELSE 'sar_normal' END AS region, CASE WHEN l_orderkey % 17 <> 0 THEN (l_discount - 0.05) * l_quantity END AS ai, l_linenumber, l_orderkey FROM lineitem)"


def _ai(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_returnflag").alias("op"), F.when(F.col("l_linenumber") == 1, "anomaly").otherwise("sar_normal").alias("region"), F.when(F.col("l_orderkey") % 17 != 0, (F.col("l_discount") - 0.05) * F.col("l_quantity")).alias("ai"), "l_linenumber", "l_orderkey")


@query(f"""WITH {AI_SQL}, t AS (SELECT series_id, op, max(CASE WHEN region = 'anomaly' THEN ai END) AS ai_anom, median(CASE WHEN region = 'sar_normal' THEN abs(ai) END) AS den, count(CASE WHEN region = 'sar_normal' THEN abs(ai) END) AS n_pos FROM ai GROUP BY ALL),
f AS (SELECT *, coalesce(den < 1e-6, false) AS den_zero, n_pos < 5 AS excluded FROM t)
SELECT series_id, op, round(ai_anom, 6) AS ai_anom, round(den, 6) AS den, n_pos, den_zero, excluded, ai_anom > 0 AS reversal, round(CASE WHEN NOT den_zero AND NOT excluded AND ai_anom IS NOT NULL THEN greatest(0.0, -ai_anom) / den END, 6) AS sar, round(CASE WHEN NOT den_zero AND NOT excluded AND ai_anom IS NOT NULL THEN abs(ai_anom) / den END, 6) AS sar_abs FROM f""")
def sar_table(spark: SparkSession, d: str) -> DataFrame:
    out = X.sar_table(_ai(spark, d))
    return out.select("series_id", "op", r6(F.col("ai_anom")).alias("ai_anom"), r6(F.col("den")).alias("den"), "n_pos", "den_zero", "excluded", "reversal", r6(F.col("sar")).alias("sar"), r6(F.col("sar_abs")).alias("sar_abs"))


@query(f"""WITH {AI_SQL}, m AS (SELECT series_id, op, median(ai) AS v FROM ai GROUP BY ALL)
SELECT op, count(v)::BIGINT AS n, round(median(v), 6) AS med, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(avg((v > 0)::INT), 6) AS share_pos FROM m GROUP BY op""")
def ai_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median over regions of each series, then median and quartiles over series."""
    m = _ai(spark, d).groupBy("series_id", "op").agg(F.median("ai").alias("v"))
    q = m.groupBy("op").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("q"), r6(F.avg((F.col("v") > 0).cast("int"))).alias("share_pos"))
    return q.select("op", "n", *[r6(F.get("q", i)).alias(c) for i, c in enumerate(("med", "q25", "q75"))], "share_pos")


@query(f"""{DETECTION}, sd AS (SELECT series_id, stddev_pop(score) AS sd, quantile_cont(score, 0.95) AS thr FROM sc GROUP BY 1), w AS (SELECT sc.series_id, idx % 3 AS k, lag(score) OVER (PARTITION BY sc.series_id ORDER BY idx) AS before, score AS after, sd, thr FROM sc JOIN sd USING (series_id))
SELECT k, round(median((after - before) / nullif(sd, 0)), 6) AS ai, round(avg((after > thr)::INT), 6) AS violation_rate FROM w GROUP BY k""")
def artifact_index(spark: SparkSession, d: str) -> DataFrame:
    sc = _scores(spark, d)
    sd = sc.groupBy("series_id").agg(F.stddev_pop("score").alias("sd"), F.percentile("score", F.lit(0.95)).alias("thr"))
    w = sc.withColumn("before", F.lag("score").over(Window.partitionBy("series_id").orderBy("idx"))).withColumnRenamed("score", "after").join(sd, "series_id").withColumn("k", F.col("idx") % 3)
    return X.artifact_index(w, ["k"]).select("k", r6(F.col("ai")).alias("ai"), r6(F.col("violation_rate")).alias("violation_rate"))


@query(f"""WITH {A.S_SQL}, {A.L_SQL} SELECT series_id, round(avg(x) FILTER (WHERE idx < te), 6) AS train_mean, (greatest(te, 0) - 0)::BIGINT AS n_train,
 (greatest(0, least(s0 - w, n) - te) + greatest(0, n - greatest(s1 + w, te)))::BIGINT AS n_normal, greatest(s0 - w + 1, te) AS o0, least(s1 + w - 1, n) AS o1 FROM s JOIN l USING (series_id) GROUP BY series_id, n, te, s0, s1, w""")
def layout_summary(spark: SparkSession, d: str) -> DataFrame:
    """Training mean, sizes of the certainly normal stretches, and the interval explanations refer to."""
    lay = S.checked(A.layouts(spark, d))
    o0, o1 = S.omega()
    n = F.aggregate(S.normal_pieces(), F.lit(0).cast("long"), lambda acc, p: acc + p["p1"] - p["p0"])
    j = A.series(spark, d).join(lay, "series_id").groupBy("series_id", "n", "te", "s0", "s1", "w").agg(r6(F.avg(F.when(F.col("idx") < F.col("te"), F.col("x")))).alias("train_mean"))
    return j.select("series_id", "train_mean", F.col("te").alias("n_train"), n.alias("n_normal"), o0.alias("o0"), o1.alias("o1"))


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, k AS (SELECT *, unnest([1, 2, 3]) AS len FROM l), e AS (SELECT *, [{{'lo': te + w - 1, 'hi': least(s0 - w, n) - len - w + 1}}, {{'lo': greatest(s1 + w, te) + w - 1, 'hi': n - len - w + 1}}] AS rr FROM k), f AS (SELECT series_id, len, list_filter(rr, lambda y: y.hi >= y.lo) AS rr FROM e)
SELECT series_id, len::BIGINT AS len, coalesce(list_sum(list_transform(rr, lambda y: y.hi - y.lo + 1)), 0)::BIGINT AS n_starts, coalesce(list_sum(list_transform(rr, lambda y: (y.hi - y.lo) // len + 1)), 0)::BIGINT AS n_disjoint FROM f""")
def admissible_regions(spark: SparkSession, d: str) -> DataFrame:
    k = A.layouts(spark, d).withColumn("len", F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 2, 3)])))
    return k.select("series_id", "len", S.n_admissible(F.col("len")).alias("n_starts"), S.max_disjoint(F.col("len")).alias("n_disjoint"))


@query(f"""WITH {A.S_SQL}, f AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM s WHERE event_type = 'error') SELECT series_id, min(idx) AS a, max(idx) + 1 AS b FROM f GROUP BY series_id, g""")
def label_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of labelled points."""
    return S.islands(A.series(spark, d), F.col("event_type") == "error")


# --- entities


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL}, pr AS (SELECT x.num AS a, y.num AS b, 'name' AS reason FROM meta x JOIN meta y ON x.name_group = y.name_group AND x.num < y.num UNION ALL SELECT x.num, y.num, 'length' FROM meta x JOIN meta y ON x.domain = y.domain AND x.num < y.num AND x.name_group <> y.name_group AND abs(x.length - y.length) <= 0.01 * greatest(x.length, y.length)),
c AS (SELECT a, b, CASE WHEN count(*) >= 2 AND max(p.x) > min(p.x) AND max(q.x) > min(q.x) THEN corr(p.x, q.x) END AS corr FROM pr JOIN meta u ON u.num = a JOIN meta v ON v.num = b JOIN s p ON p.series_id = a JOIN s q ON q.series_id = b AND q.idx = p.idx WHERE p.idx < least(5000, u.te, v.te) GROUP BY a, b)
SELECT a, b, reason, round(corr, 6) AS corr, coalesce(corr >= 0.3, false) AS same FROM pr LEFT JOIN c USING (a, b)""")
def recording_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of series worth comparing and the correlation of their whole training parts; the SQL stops at 5,000 points."""
    refs = A.meta(spark, d)
    out = E.compare_candidates(refs, A.series(spark, d), least=0.3)
    return out.select("a", "b", "reason", r6(F.col("corr")).alias("corr"), "same")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
lab(num, root) USING KEY (num) AS (SELECT DISTINCT a, a FROM bi UNION (SELECT bi.b, min(r.root) FROM lab r JOIN bi ON bi.a = r.num JOIN recurring.lab c ON c.num = bi.b WHERE r.root < c.root GROUP BY bi.b))
SELECT num, root, count(*) OVER (PARTITION BY root) AS group_size FROM lab""")
def content_groups(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of parts and suppliers over all lines."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("num")).union(e.select("b")).distinct()
    return E.group_labels(E.components(nodes, e)).select("num", "root", "group_size")


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL} SELECT 'split' AS direction, domain AS key, array_to_string(list_sort(list(DISTINCT variant)), ',') AS members FROM meta GROUP BY domain HAVING count(DISTINCT variant) > 1
UNION ALL SELECT 'merged', variant, array_to_string(list_sort(list(DISTINCT domain)), ',') FROM meta GROUP BY variant HAVING count(DISTINCT domain) > 1""")
def group_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return E.grouping_disagreements(A.meta(spark, d), "domain", "variant").withColumn("members", F.array_join("members", ","))


SUBSETS = {"all": {}, "plain": {"variant": "plain"}, "clicks": {"domain": {"in": ["click", "view"]}}, "odd": {"variant": {"not_in": ["plain", "NA"]}, "domain": {"not_in": "error"}}}


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL}, t AS (SELECT *, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN variant = 'plain' THEN 'plain' END, CASE WHEN domain IN ('click', 'view') THEN 'clicks' END, CASE WHEN variant <> 'plain' AND domain <> 'error' THEN 'odd' END], lambda y: y IS NOT NULL)) AS subset FROM meta)
SELECT subset, count(*) AS n_series, count(DISTINCT name_group) AS n_groups, count(DISTINCT name_group) < 30 AS descriptive_only FROM t GROUP BY subset""")
def subset_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.subset_summary(A.meta(spark, d), SUBSETS, group="name_group")


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL} SELECT 0 AS step, 'length' AS name, count_if(length >= 55) AS n FROM meta UNION ALL SELECT 1, 'variant', count_if(length >= 55 AND variant = 'plain') FROM meta UNION ALL SELECT 2, 'domain', count_if(length >= 55 AND variant = 'plain' AND domain <> 'error') FROM meta""")
def selection_funnel(spark: SparkSession, d: str) -> DataFrame:
    return E.funnel(A.meta(spark, d), {"length": F.col("length") >= 55, "variant": F.col("variant") == "plain", "domain": F.col("domain") != "error"})


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, o AS (SELECT series_id, s0 + series_id % 5 * 2 AS s0, s1, n - series_id % 7 AS n, te, w FROM l), t AS (SELECT o.series_id, o.n, o.te, o.s0, o.s1, o.w, min(x) FILTER (WHERE idx < o.te) AS tmin, max(x) FILTER (WHERE idx < o.te) AS tmax, min(x) AS lo, max(x) AS hi FROM o JOIN s USING (series_id) GROUP BY ALL),
f AS (SELECT unnest(list_filter([CASE WHEN s1 > n THEN 'end_gt_len' END, CASE WHEN s0 + 1 > s1 THEN 'begin_gt_end' END, CASE WHEN s0 + 1 <= te THEN 'begin_le_train_end' END, CASE WHEN te >= n THEN 'train_end_ge_len' END, CASE WHEN tmin = tmax THEN 'const_train' END, CASE WHEN lo = hi THEN 'const_series' END, CASE WHEN te < 4 * w THEN 'short_train' END], lambda y: y IS NOT NULL)) AS flag FROM t)
SELECT flag, count(*) AS n FROM f GROUP BY flag""")
def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags over layouts that are shifted on purpose."""
    k = F.col("series_id")
    lay = A.layouts(spark, d).withColumn("s0", F.col("s0") + k % 5 * 2).withColumn("n", F.col("n") - k % 7)
    return E.flag_counts(E.audit(A.series(spark, d), lay))


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, b AS (SELECT series_id, median(x) AS m FROM s JOIN l USING (series_id) WHERE idx < te GROUP BY 1), md AS (SELECT s.series_id, median(abs(x - m)) AS mad FROM s JOIN l USING (series_id) JOIN b USING (series_id) WHERE idx < te GROUP BY 1)
SELECT s.series_id, idx, x = 10.0 AS exact, CASE WHEN idx >= s0 AND idx < s1 THEN 'in_gt' WHEN idx < te THEN 'in_train' ELSE 'in_test_normal' END AS part FROM s JOIN l USING (series_id) JOIN md USING (series_id) WHERE abs(x - 10.0) <= 3 * mad""")
def sentinel_classify(spark: SparkSession, d: str) -> DataFrame:
    return E.sentinels(A.series(spark, d), A.layouts(spark, d), value=10.0)


OUT_SQL = """ow AS (SELECT series_id, idx, x, list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS v FROM s), om AS (SELECT *, list_median(v) AS m FROM ow), od AS (SELECT series_id, idx, abs(x - m) AS off, list_median(list_transform(v, lambda y: abs(y - m))) AS dd FROM om),
orr AS (SELECT series_id, idx, CASE WHEN dd > 0 THEN off / dd WHEN off > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS ratio FROM od)"""


@query(f"WITH {A.S_SQL}, {OUT_SQL} SELECT series_id, idx, round(ratio, 6) AS ratio FROM orr")
def outlier_ratio(spark: SparkSession, d: str) -> DataFrame:
    return E.outlier_ratio(A.series(spark, d)).select("series_id", "idx", r6(F.col("ratio")).alias("ratio"))


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL}, {OUT_SQL}, ix AS (SELECT name_group, idx FROM orr JOIN meta ON num = series_id WHERE variant = 'plain' AND ratio >= 5), j AS (SELECT m.num AS series_id, m.length, ix.idx, o.ratio FROM meta m JOIN ix USING (name_group) LEFT JOIN orr o ON o.series_id = m.num AND o.idx = ix.idx WHERE variant <> 'plain'),
c AS (SELECT series_id, count_if(idx < length AND coalesce(ratio, 0) >= 5) AS confirmed, count_if(idx < length AND NOT coalesce(ratio, 0) >= 5) AS absent, count_if(idx >= length) AS length_mismatch FROM j GROUP BY 1)
SELECT *, CASE WHEN confirmed + absent = 0 THEN 'length_mismatch' WHEN absent = 0 THEN 'confirmed' WHEN confirmed = 0 THEN 'absent' ELSE 'partial' END AS status FROM c""")
def twin_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether positions that stand out in plain series do so in their variants."""
    ratios = E.outlier_ratio(A.series(spark, d))
    m = A.meta(spark, d)
    ix = ratios.where("ratio >= 5").join(m.where("variant = 'plain'"), F.col("num") == F.col("series_id")).select("name_group", "idx")
    return E.twin_check(ix, m.where("variant <> 'plain'").select("name_group", F.col("num").alias("series_id"), F.col("length").alias("n")), ratios)


@query(f"""WITH {A.S_SQL}, f AS (SELECT series_id, floor(x / 40) AS x, idx FROM s), w AS (SELECT series_id, max(x) OVER k = min(x) OVER k AND count(x) OVER k = 4 AS c FROM f WINDOW k AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT series_id, count_if(c) AS n_const FROM w GROUP BY 1""")
def constant_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.constant_windows(A.series(spark, d).withColumn("x", F.floor(F.col("x") / 40)), 4)


@query(f"""WITH {A.S_SQL}, c AS (SELECT series_id, idx, x, list_concat(coalesce(list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING), []), coalesce(list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 3 FOLLOWING AND 12 FOLLOWING), [])) AS v FROM s) SELECT series_id, idx, round(abs(x - list_median(v)), 6) AS dev FROM c""")
def local_deviation(spark: SparkSession, d: str) -> DataFrame:
    return E.local_deviation(A.series(spark, d)).select("series_id", "idx", r6(F.col("dev")).alias("dev"))


@query(f"""WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL} SELECT coalesce(domain, 'total') AS domain, count_if(variant = 'plain') AS plain, count_if(variant = 'DISTORTED') AS DISTORTED, count_if(variant = 'NOISE') AS NOISE, count(*) AS total FROM meta GROUP BY ROLLUP (domain)""")
def domain_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return E.crosstab(A.meta(spark, d), "domain", "variant", ["plain", "DISTORTED", "NOISE"])


@query("""WITH b AS (SELECT unnest([{'bin': 0, 'lo': 0.0, 'hi': 5.0}, {'bin': 1, 'lo': 5.0, 'hi': 10.0}, {'bin': 2, 'lo': 10.0, 'hi': 20.0}, {'bin': 3, 'lo': 20.0, 'hi': 50.0}, {'bin': 4, 'lo': 50.0, 'hi': 900.0}, {'bin': 5, 'lo': 900.0, 'hi': 1000.0}], recursive := true))
SELECT bin, lo::DOUBLE AS lo, hi::DOUBLE AS hi, (SELECT count(*) FROM events WHERE value >= lo AND (value < hi OR (bin = 5 AND value = hi))) AS n FROM b""")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Fixed bins, empty ones too."""
    return E.histogram(table(spark, d, "events"), "value", [0, 5, 10, 20, 50, 900, 1000])


@query("""WITH g AS (SELECT a.v AS big, b.v AS cheap, c.v AS returned FROM (SELECT unnest([true, false]) AS v) a, (SELECT unnest([true, false]) AS v) b, (SELECT unnest([true, false]) AS v) c), n AS (SELECT l_quantity >= 50 AS big, l_extendedprice < 100 AS cheap, l_returnflag = 'R' AS returned, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT big, cheap, returned, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM g LEFT JOIN n USING (big, cheap, returned)""")
def four_cells(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select((F.col("l_quantity") >= 50).alias("big"), (F.col("l_extendedprice") < 100).alias("cheap"), (F.col("l_returnflag") == "R").alias("returned"))
    return E.four_cells(f, ["big", "cheap", "returned"]).withColumn("share", r6(F.col("share")))
