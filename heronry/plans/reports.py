"""Queries: report tables, replicates, rankings, checks of scores and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import numeric as N
from heronry.operators import checks as C
from heronry.operators import entity as E
from heronry.operators import metrics as X
from heronry.operators import profile as P
from heronry.operators import replicates as Y
from heronry.operators import reports as R
from heronry.operators import series as S
from heronry.operators import stats as T
from heronry.operators import tables as B
from heronry.plans import adapters as A
from heronry.plans.detection import AI_SQL, DETECTION, DIST, _ai
from heronry.plans.evaluation import D_SQL, RANK_SQL, _effects, _ranks, draw_sql
from heronry.plans.registry import SQL, query, table
from heronry.shared import shared_path, written

r6 = N.r6


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in names})


# --- crosstabs, quantiles, flags

_SIGN_SQL = f"{AI_SQL}, t AS (SELECT series_id, op, max(CASE WHEN region = 'anomaly' THEN ai END) > 0 AS rev, avg(CASE WHEN region <> 'anomaly' THEN ai END) < 0 AS neg FROM ai GROUP BY ALL)"


def _signs(spark: SparkSession, d: str) -> DataFrame:
    anomaly = F.col("region") == "anomaly"
    return _ai(spark, d).groupBy("series_id", "op").agg((F.max(F.when(anomaly, F.col("ai"))) > 0).alias("rev"), (F.avg(F.when(~anomaly, F.col("ai"))) < 0).alias("neg"))


@query(f"WITH {_SIGN_SQL}, c AS (SELECT op, count_if(rev AND neg) AS rev_neg, count_if(rev AND NOT neg) AS rev_only, count_if(NOT rev AND neg) AS neg_only, count_if(NOT rev AND NOT neg) AS neither FROM t WHERE rev IS NOT NULL AND neg IS NOT NULL GROUP BY 1), p AS (SELECT *, rev_neg / nullif(rev_neg + rev_only, 0)::DOUBLE AS gr, neg_only / nullif(neg_only + neither, 0)::DOUBLE AS go FROM c) SELECT op, rev_neg, rev_only, neg_only, neither, round(gr, 6) AS given_reversal, round(go, 6) AS given_other, round(gr - go, 6) AS difference FROM p")
def reversal_signs(spark: SparkSession, d: str) -> DataFrame:
    """Whether reversals go with negative effects."""
    return _r6(R.conditional_signs(_signs(spark, d), ["op"], "rev", "neg"), "given_reversal", "given_other", "difference")


_DELTA_SQL = "dl AS (SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS delta FROM orders)"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("delta"))


@query(f"WITH {_DELTA_SQL} SELECT CASE WHEN delta <> 0 THEN floor(log10(abs(delta)))::BIGINT END AS decade, count(*) AS n FROM dl WHERE delta IS NOT NULL GROUP BY 1")
def delta_decades(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of differences by powers of ten."""
    return R.decades(_deltas(spark, d), "delta")


@query(f"WITH {_DELTA_SQL}, q AS (SELECT unnest([0.5, 0.9, 0.99]) AS q) SELECT q::DOUBLE AS q, round((SELECT CASE q WHEN 0.5 THEN quantile_cont(abs(delta), 0.5) WHEN 0.9 THEN quantile_cont(abs(delta), 0.9) ELSE quantile_cont(abs(delta), 0.99) END FROM dl), 6) AS v FROM q")
def delta_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _r6(R.quantiles(_deltas(spark, d), [], F.abs("delta"), [0.5, 0.9, 0.99]), "v")


_POS_SQL = "ps AS (SELECT l_suppkey AS series_id, l_returnflag AS op, count(*) AS c FROM lineitem GROUP BY ALL), fl AS (SELECT series_id, count(*)::INT AS n_kinds, sum(c)::INT AS n_positions, bool_or(c >= 10 AND c < 20) AS any_short, bool_or(c < 10) AS any_dropped FROM ps GROUP BY 1)"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_returnflag").alias("op")).agg(F.collect_list("l_orderkey").alias("p"))
    text = p.groupBy("series_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("op", "p")))).alias("positions"))
    return R.position_flags(text, "series_id", F.col("positions"))


@query(f"WITH {_POS_SQL} SELECT * FROM fl")
def position_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which series have short or dropped lists of positions, from JSON."""
    return _flags(spark, d)


@query(f"WITH {_POS_SQL} SELECT count(*) AS series, count_if(any_short) AS short, count_if(any_dropped) AS dropped, sum(n_positions)::BIGINT AS positions FROM fl")
def position_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(_flags(spark, d))


@query(f"WITH {A.SPAN_SQL}, c AS (SELECT trace_id, count(*) AS turns, count_if(kind = 'human') AS human, count_if(status = 'rejected') AS rejected FROM sp GROUP BY 1) SELECT *, round(human / turns::DOUBLE, 6) AS human_ratio, round(rejected / turns::DOUBLE, 6) AS rejected_ratio FROM c")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r6(R.session_summary(A.spans(spark, d)), "human_ratio", "rejected_ratio")


@query(f"WITH {A.S_SQL} SELECT series_id, idx AS seg, row_number() OVER (PARTITION BY series_id ORDER BY round(x) DESC, idx) AS most, row_number() OVER (PARTITION BY series_id ORDER BY round(x), idx) AS least FROM s")
def index_tie_order(spark: SparkSession, d: str) -> DataFrame:
    """Both orders of a series' points, ties by position in both."""
    return R.order_by_index(A.series(spark, d).select("series_id", F.col("idx").alias("seg"), F.round("x").alias("value"))).select("series_id", "seg", F.col("most").cast("long").alias("most"), F.col("least").cast("long").alias("least"))


@query("""WITH q AS (SELECT c_nationkey AS g, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS v FROM customer GROUP BY 1), n AS (SELECT g, i, c_custkey AS k, row_number() OVER (PARTITION BY g, i ORDER BY round(abs(c_acctbal - v[i]), 9), c_custkey) AS r FROM (SELECT *, unnest([1, 2, 3]) AS i FROM q) JOIN customer ON c_nationkey = g),
a AS (SELECT g, k FROM n WHERE i = 1 AND r = 1), b AS (SELECT n.g, arg_min(n.k, r) AS k FROM n LEFT JOIN a ON a.g = n.g AND a.k = n.k WHERE i = 2 AND a.k IS NULL GROUP BY 1), c AS (SELECT n.g, arg_min(n.k, r) AS k FROM n LEFT JOIN a ON a.g = n.g AND a.k = n.k LEFT JOIN b ON b.g = n.g AND b.k = n.k WHERE i = 3 AND a.k IS NULL AND b.k IS NULL GROUP BY 1)
SELECT g AS c_nationkey, 0.25::DOUBLE AS q, k AS c_custkey FROM a UNION ALL SELECT g, 0.5, k FROM b UNION ALL SELECT g, 0.75, k FROM c""")
def quantile_picks(spark: SparkSession, d: str) -> DataFrame:
    """Customers nearest to the quartiles of their nation's balances, none twice."""
    return R.nearest_to_quantiles(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey", "c_acctbal", [0.25, 0.5, 0.75])


@query("WITH f AS (SELECT user_id AS g, event_type AS v, event_id FROM events) SELECT v AS event_type, count(*) AS n FROM f GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 3")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent types, the first seen of equals: the limit is the feature."""
    return R.most_common(table(spark, d, "events"), "event_type", "event_id", 3)


# --- splits, residuals, bins


@query(f"WITH {AI_SQL}, m AS (SELECT op, region, series_id, median(ai) AS m FROM ai GROUP BY ALL) SELECT op, region, count(DISTINCT series_id) AS units, round(median(m), 6) AS med FROM m GROUP BY ALL")
def split_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of series' medians, by operator and by a split."""
    return _r6(R.split_medians(_ai(spark, d), ["op"], "region", "ai", "series_id"), "med")


_RES_SQL = "rs AS (SELECT l_returnflag AS op, l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) AS pred, round(l_extendedprice * (1 - l_discount) * (1 + CASE WHEN l_tax > 0.07 THEN 0.0001 ELSE 0 END), 2) AS seen FROM lineitem), rr AS (SELECT *, abs(pred - seen) AS r FROM rs)"


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("op"), "l_orderkey", "l_linenumber", N.scaled_round(net, 2).alias("pred"), N.scaled_round(net * (F.lit(1) + F.when(F.col("l_tax") > 0.07, 0.0001).otherwise(0.0)), 2).alias("seen"))


@query(f"WITH {_RES_SQL} SELECT op, count(r) AS cases, round(avg((r <= 0.5)::INT), 6) AS match_rate, count_if(r > 0.5) AS mismatches, round(max(r), 4) AS largest, round(quantile_cont(r, 0.99), 4) AS q99, round(median(r), 4) AS med, count_if(r = 0) AS zeros FROM rr GROUP BY 1")
def prediction_check(spark: SparkSession, d: str) -> DataFrame:
    """Predicted against seen values: matches, and the residual's range."""
    out = R.residual_check(_residuals(spark, d), ["op"], F.col("pred"), F.col("seen"), 0.5)
    return out.withColumn("match_rate", r6(F.col("match_rate"))).withColumns({c: N.scaled_round(F.col(c), 4) for c in ("largest", "q99", "med")})


@query(f"WITH {_RES_SQL}, m AS (SELECT l_orderkey, l_linenumber FROM rr WHERE r > 0.5) SELECT *, (SELECT greatest(0, count(*) - 200) FROM m)::BIGINT AS more FROM m ORDER BY l_orderkey, l_linenumber LIMIT 200")
def prediction_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 mismatches and how many more there are: the limit is the feature."""
    bad = _residuals(spark, d).where("abs(pred - seen) > 0.5").select("l_orderkey", "l_linenumber")
    return R.listed(bad, ["l_orderkey", "l_linenumber"], 200)


@query("SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '(0,10]' WHEN l_quantity > 10 AND l_quantity <= 30 THEN '(10,30]' WHEN l_quantity > 30 AND l_quantity <= 45 THEN '(30,45]' END AS bin, count(*) AS n, round(avg(l_tax), 6) AS mean, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY 1")
def binned_means(spark: SparkSession, d: str) -> DataFrame:
    """Means and totals by bins of a size; what lies outside has no bin."""
    return _r6(R.binned(table(spark, d, "lineitem"), "l_quantity", [0, 10, 30, 45], F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("mean"), F.sum("l_discount").alias("total")), "mean", "total")


@query(f"WITH {AI_SQL}, c AS (SELECT op, region, coalesce(abs(ai) <= 2, false) AS ok FROM ai) SELECT op, region, count(*) AS cases, round(avg(ok::INT), 6) AS match_rate, count_if(NOT ok) AS mismatches, 1 - avg(ok::INT) > 0.01 AS stop FROM c GROUP BY ALL")
def consistency_checks(spark: SparkSession, d: str) -> DataFrame:
    """Share of effects within tolerance, and whether to stop."""
    return _r6(C.mismatch_rate(_ai(spark, d), ["op", "region"], F.abs("ai") <= 2), "match_rate")


@query("SELECT 'positive' AS rule, count_if(NOT coalesce(l_quantity > 0, false)) AS failed, count_if(NOT coalesce(l_quantity > 0, false)) = 0 AS passes FROM lineitem UNION ALL SELECT 'low_tax', count_if(l_tax > 0.07), count_if(l_tax > 0.07) = 0 FROM lineitem UNION ALL SELECT 'shipped', count_if(l_shipdate IS NULL), count_if(l_shipdate IS NULL) = 0 FROM lineitem")
def sanity_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Rules over all rows, counted in one pass."""
    return C.assertions(table(spark, d, "lineitem"), {"positive": F.col("l_quantity") > 0, "low_tax": F.col("l_tax") <= 0.07, "shipped": F.col("l_shipdate").isNotNull()})


# --- replicates and rankings

_REP_SQL = "li AS (SELECT l_suppkey AS unit, l_returnflag AS op, 'am' || (month(l_shipdate) % 4) AS am, l_orderkey * 10 + l_linenumber AS seq, min(l_discount - 0.05) AS v FROM lineitem GROUP BY ALL), rp AS (SELECT *, unnest(range(0, 21)) AS k FROM li), ch AS (SELECT *, row_number() OVER (PARTITION BY k, unit, op, am ORDER BY CASE WHEN k = 0 THEN 0.0 ELSE ('0x' || substr(md5('7:' || k || ':' || seq), 1, 12))::BIGINT / 281474976710656.0 END, seq) AS r FROM rp), cl AS (SELECT k, op, am, count(v) AS n, round(avg(v), 9) AS mean, round(avg(sign(v)), 9) AS pes FROM ch WHERE r = 1 GROUP BY ALL), ck AS (SELECT *, CASE WHEN mean * pes <= 0 THEN 0.0 ELSE 2 / (1 / abs(mean) + 1 / abs(pes)) END AS cmi, CASE WHEN mean = 0 OR pes = 0 THEN 'zero' WHEN mean > 0 AND pes > 0 THEN '(+,+)' WHEN mean < 0 AND pes < 0 THEN '(-,-)' ELSE 'conflict' END AS sign_type, rank() OVER (PARTITION BY k, op ORDER BY mean DESC) + (count(*) OVER (PARTITION BY k, op, mean) - 1) / 2.0::DOUBLE AS rank FROM cl)"


def _ties(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a supplier with the same flag and month: several of which one counts."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("op"), F.concat(F.lit("am"), F.month("l_shipdate") % 4).alias("am"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_discount") - 0.05).alias("v"))  # noqa: E741
    return l.repartition("unit", "op", "am").groupBy("unit", "op", "am", "seq").agg(F.min("v").alias("v"))  # moved as the choice needs them


def _replicates(spark: SparkSession, d: str) -> DataFrame:
    return R.replicate_cells(R.tie_replicates(_ties(spark, d), ["unit", "op", "am"], "seq", 20, together=True))


@query(f"WITH {_REP_SQL} SELECT k::INT AS k, op, am, n, round(mean, 6) AS mean, round(pes, 6) AS pes, round(cmi, 6) AS cmi, sign_type, rank FROM ck")
def tie_replicates(spark: SparkSession, d: str) -> DataFrame:
    """Cells when ties are broken anew; replicate 0 is the stored one."""
    return _r6(_replicates(spark, d), "mean", "pes", "cmi")


@query(SQL["tie_replicates"])
def resumed_replicates(spark: SparkSession, d: str) -> DataFrame:
    """The same by replicates that are committed one by one: a run that ends after the seventh, and one that goes on."""
    rows, keys = written(_ties(spark, d), "ties"), ["unit", "op", "am"]
    stored = written(R.tie_replicates(rows, keys, "seq", 0).drop("k"), "stored")
    folder = shared_path(spark, "replicates")
    Y.run_replicates(rows, keys, "seq", folder, stored, replicates=20, stop_after=7)
    held = Y.run_replicates(rows, keys, "seq", folder, stored, replicates=20)
    return _r6(R.replicate_cells(held.read()), "mean", "pes", "cmi")


@query(f"WITH {_REP_SQL}, b AS (SELECT op, max(mean) AS base FROM ck WHERE k > 0 AND am = 'am0' GROUP BY 1) SELECT op, am, count_if(rank = 1) AS firsts, count_if(rank > 1 AND rank < 2) AS tied_firsts, round(min(mean), 6) AS least, round(median(mean), 6) AS med, round(max(mean), 6) AS most, count_if(mean > base) AS above_baseline FROM ck LEFT JOIN b USING (op) WHERE k > 0 GROUP BY ALL")
def replicate_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often each method comes first over replicates, and whether it beats the baseline's best."""
    return _r6(R.replicate_summary(_replicates(spark, d), "am0"), "least", "med", "most")


_W_SQL = "sw AS (SELECT {keys}, am, sum(rank) AS s, count(DISTINCT {rater}) AS m FROM {ranks} GROUP BY ALL), ww AS (SELECT {keys}, max(m) AS raters, count(*) AS items, CASE WHEN count(*) > 1 AND max(m) > 1 THEN 12.0 * var_pop(s) * count(*) / (max(m) * max(m) * (count(*) * count(*) * count(*) - count(*))) END AS w FROM sw GROUP BY ALL)"


@query(f"""WITH {D_SQL}, full_ AS (SELECT unit FROM dd GROUP BY 1 HAVING count(v) = 12), vv AS (SELECT unit, op, am, round(v, 9) AS v FROM dd JOIN full_ USING (unit)), rk AS (SELECT unit, op, am, rank() OVER (PARTITION BY unit, op ORDER BY v DESC) + (count(*) OVER (PARTITION BY unit, op, v) - 1) / 2.0::DOUBLE AS rank FROM vv), {_W_SQL.format(keys="unit", rater="op", ranks="rk")} SELECT unit, raters, items, round(w, 6) AS w FROM ww""")
def series_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Concordance of operators in each unit; units with an empty cell are left out."""
    e = _effects(spark, d).withColumn("v", F.round("v", 9))
    whole = e.groupBy("unit").agg(F.count("v").alias("c")).where("c = 12").select("unit")
    ranks = e.join(whole, "unit").withColumn("rank", N.average_rank(F.col("v"), ["unit", "op"]))
    return _r6(R.concordance(ranks, ["unit"], "op", "am"), "w")


_BOOT_W = 1000


@query(f"""WITH {D_SQL}, {draw_sql('dw', 'dd', _BOOT_W)}, mb AS (SELECT b, op, am, round(avg(v), 9) AS v FROM dw JOIN dd USING (unit) GROUP BY ALL), rk AS (SELECT b, op, am, rank() OVER (PARTITION BY b, op ORDER BY v DESC) + (count(*) OVER (PARTITION BY b, op, v) - 1) / 2.0::DOUBLE AS rank FROM mb), {_W_SQL.format(keys="b", rater="op", ranks="rk")} SELECT round(quantile_cont(w, 0.025), 6) AS lo, round(quantile_cont(w, 0.975), 6) AS hi, count(w) AS n_rep FROM ww""")
def concordance_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of Kendall's W over resampled units."""
    e = _effects(spark, d)
    means = T.draws(spark, e, _BOOT_W).join(e, "unit").groupBy("b", "op", "am").agg(F.round(F.avg("v"), 9).alias("v"))
    w = R.concordance(means.withColumn("rank", N.average_rank(F.col("v"), ["b", "op"])), ["b"], "op", "am")
    return w.agg(r6(F.percentile("w", F.lit(0.025))).alias("lo"), r6(F.percentile("w", F.lit(0.975))).alias("hi"), F.count("w").alias("n_rep"))


_OVER_SQL = f"{D_SQL}, mn AS (SELECT op, am, round(avg(dd.v), 9) AS v, CASE WHEN am = 'am1' THEN round(avg(abs(dd.v)), 9) END AS o FROM dd GROUP BY op, am), ov AS (SELECT op, am, rank() OVER (PARTITION BY op ORDER BY v DESC) + (count(*) OVER (PARTITION BY op, v) - 1) / 2.0::DOUBLE AS rank, rank() OVER (PARTITION BY op ORDER BY coalesce(o, v) DESC) + (count(*) OVER (PARTITION BY op, coalesce(o, v)) - 1) / 2.0::DOUBLE AS rank_override FROM mn)"


def _override(spark: SparkSession, d: str) -> DataFrame:
    e = _effects(spark, d)
    main = e.groupBy("op", "am").agg(F.round(F.avg("v"), 9).alias("value"))
    other = e.where("am = 'am1'").groupBy("op", "am").agg(F.round(F.avg(F.abs("v")), 9).alias("value"))
    return R.override_ranks(main, other, ["op"], "am")


@query(f"WITH {_OVER_SQL} SELECT * FROM ov")
def override_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of methods, and again with one method's values replaced."""
    return _override(spark, d)


@query(f"WITH {_OVER_SQL} SELECT op, count(*) AS n, round(CASE WHEN max(rank) > min(rank) AND max(rank_override) > min(rank_override) THEN corr(rank, rank_override) END, 6) AS rho FROM ov GROUP BY 1")
def override_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """How much the replacement moves the order."""
    return _r6(R.rank_agreement(_override(spark, d), ["op"], "rank", "rank_override"), "rho")


@query(f"WITH {RANK_SQL}, a AS (SELECT op, am, rank FROM rk), m AS (SELECT op, am, round(median(v), 9) AS v FROM dd GROUP BY ALL), b AS (SELECT op, am, rank() OVER (PARTITION BY op ORDER BY v DESC) + (count(*) OVER (PARTITION BY op, v) - 1) / 2.0::DOUBLE AS rank FROM m) SELECT op, am, a.rank AS rank_a, b.rank AS rank_b, a.rank IS DISTINCT FROM b.rank AS rank_changed FROM a FULL JOIN b USING (op, am)")
def rank_versions(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by means and by medians, side by side."""
    med = _effects(spark, d).groupBy("op", "am").agg(F.round(F.median("v"), 9).alias("v")).withColumn("rank", N.average_rank(F.col("v"), ["op"]))
    return R.version_table(_ranks(spark, d), med, ["op", "am"], ["rank"])


@query(f"""WITH {D_SQL}, ab AS (SELECT x.unit, x.am, round(x.v, 9) AS a, round(y.v, 9) AS b FROM dd x JOIN dd y ON x.unit = y.unit AND x.am = y.am AND x.op = 'A' AND y.op = 'R'), p AS (SELECT x.unit, sign(x.a - y.a) AS sa, sign(x.b - y.b) AS sb FROM ab x JOIN ab y ON x.unit = y.unit AND x.am < y.am),
t AS (SELECT unit, sum(sa * sb) / nullif(sqrt(sum(sa * sa)::DOUBLE) * sqrt(sum(sb * sb)::DOUBLE), 0) AS tau FROM p GROUP BY 1) SELECT count(tau) AS n, round(quantile_cont(round(tau, 9), 0.25), 6) AS q25, round(median(round(tau, 9)), 6) AS med, round(quantile_cont(round(tau, 9), 0.75), 6) AS q75, round(avg((round(tau, 9) < 0)::INT), 6) AS negative FROM t""")
def series_tau(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two operators' orders in each unit, and how it is spread."""
    e = _effects(spark, d).withColumn("v", F.round("v", 9))
    ab = e.where("op = 'A'").select("unit", "am", F.col("v").alias("a")).join(e.where("op = 'R'").select("unit", "am", F.col("v").alias("b")), ["unit", "am"])
    p = ab.alias("x").join(ab.alias("y"), "unit").where("x.am < y.am").select("unit", F.signum(F.col("x.a") - F.col("y.a")).alias("sa"), F.signum(F.col("x.b") - F.col("y.b")).alias("sb"))
    tau = p.groupBy("unit").agg(F.round(F.sum(F.col("sa") * F.col("sb")) / F.nullif(F.sqrt(F.sum(F.col("sa") * F.col("sa"))) * F.sqrt(F.sum(F.col("sb") * F.col("sb"))), F.lit(0.0)), 9).alias("tau"))
    return _r6(tau.agg(F.count("tau").alias("n"), F.percentile("tau", F.lit(0.25)).alias("q25"), F.median("tau").alias("med"), F.percentile("tau", F.lit(0.75)).alias("q75"), F.avg((F.col("tau") < 0).cast("int")).alias("negative")), "q25", "med", "q75", "negative")


# --- checks of scores, runs and plans


@query(f"WITH {A.S_SQL}, {A.L_SQL}, sc AS (SELECT series_id, idx, CASE WHEN series_id % 11 = 0 AND idx = 3 THEN 'NaN'::DOUBLE WHEN series_id % 13 = 0 THEN 1.0 ELSE x END AS score FROM s WHERE NOT (series_id % 7 = 0 AND idx = 0) AND series_id % 17 <> 0), g AS (SELECT series_id, count(*) AS r, count_if(isnan(score)) AS bad, min(score) = max(score) AS constant FROM sc GROUP BY 1) SELECT series_id, CASE WHEN r IS NULL THEN 'missing' WHEN r <> n THEN 'bad_length' WHEN bad > 0 THEN 'not_finite' WHEN constant THEN 'constant' ELSE 'ok' END AS status, coalesce(constant, false) AND coalesce(bad, 0) = 0 AS constant FROM l LEFT JOIN g USING (series_id)")
def score_status(spark: SparkSession, d: str) -> DataFrame:
    """Scores against layouts, with faults planted."""
    k, i = F.col("series_id"), F.col("idx")
    s = A.series(spark, d).where(~((k % 7 == 0) & (i == 0)) & (k % 17 != 0))
    score = F.when((k % 11 == 0) & (i == 3), float("nan")).when(k % 13 == 0, 1.0).otherwise(F.col("x"))
    return C.score_status(s.select("series_id", "idx", score.alias("score")), A.layouts(spark, d), constant="error")


@query("WITH h AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY ('0x' || substr(md5('7:' || c_custkey), 1, 12))::BIGINT, c_custkey) AS r FROM customer) SELECT 'pick' AS operator, count(*) AS n, true AS same FROM h WHERE r <= 2 UNION ALL SELECT 'collapse', count(DISTINCT c_nationkey), true FROM customer UNION ALL SELECT 'draws', 50 * count(DISTINCT c_nationkey), true FROM customer")
def determinism(spark: SparkSession, d: str) -> DataFrame:
    """Whether seeded operators give the same rows twice, and how many: on another partitioning the second time."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    runs = {
        "pick": lambda t: T.pick(t, "c_nationkey", 2, key="c_custkey"),
        "collapse": lambda t: B.one_of_each(t, "c_nationkey", "c_custkey"),
        "draws": lambda t: T.draws(spark, t.select(F.col("c_nationkey").alias("unit")), 50),
    }
    rows = []
    for name, run in runs.items():
        inputs = iter([c, c.repartition(7, "c_custkey")])
        rows.append((name, run(c).count(), C.same_rows_twice(lambda run=run, inputs=inputs: run(next(inputs)))))
    return spark.createDataFrame(rows, "operator string, n long, same boolean")


@query(f"WITH {A.S_SQL}, {A.L_SQL} SELECT series_id, (te * (n - te))::BIGINT AS estimate, te * (n - te) <= 1000 AS admitted FROM l")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    """Which profiles are cheap enough, before any is computed."""
    return C.preflight(A.layouts(spark, d), F.col("te") * (F.col("n") - F.col("te")), 1000).select("series_id", "estimate", "admitted")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice / 2, 6) END AS output, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'out_of_envelope' END AS status FROM orders")
def envelope(spark: SparkSession, d: str) -> DataFrame:
    """A function that refuses rows outside its conditions."""
    out = C.within_envelope(table(spark, d, "orders"), F.col("o_orderstatus") == "F", r6(F.col("o_totalprice") / 2))
    return out.select("o_orderkey", "output", "status")


@query(f"WITH {A.S_SQL}, {A.L_SQL}, r AS (SELECT series_id, s0 - 2 AS a, s1 AS b, n FROM l UNION ALL SELECT series_id, s0, s1 + series_id % 4 * 3, n FROM l UNION ALL SELECT series_id, te, te, n FROM l), w AS (SELECT *, max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM r), f AS (SELECT series_id, a, b, CASE WHEN b <= a THEN 'empty' WHEN a < 0 OR b > n THEN 'out_of_bounds' WHEN a < pb THEN 'overlap' END AS fault FROM w) SELECT * FROM f WHERE fault IS NOT NULL")
def run_faults(spark: SparkSession, d: str) -> DataFrame:
    """Runs that are empty, out of bounds, or overlap."""
    lay = A.layouts(spark, d)
    runs = lay.select("series_id", (F.col("s0") - 2).alias("a"), F.col("s1").alias("b"), "n").union(lay.select("series_id", "s0", F.col("s1") + F.col("series_id") % 4 * 3, "n")).union(lay.select("series_id", "te", "te", "n"))
    return C.run_faults(runs)


@query(f"WITH {A.S_SQL}, c AS (SELECT series_id, list(x ORDER BY idx) FILTER (WHERE event_type = 'click') AS m, list(x ORDER BY idx) FILTER (WHERE event_type = 'view') AS l FROM s GROUP BY 1) SELECT series_id, CASE WHEN coalesce(len(m), 0) <> coalesce(len(l), 0) THEN 'length' WHEN coalesce(len(m), 0) < 2 THEN 'too_short' END AS fault FROM c")
def curve_faults(spark: SparkSession, d: str) -> DataFrame:
    """Why two curves of a series can't be compared."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("idx", "x")))), lambda p: p["x"])
    c = A.series(spark, d).groupBy("series_id").agg(of("click").alias("m"), of("view").alias("l"))
    return c.select("series_id", C.curve_fault(F.col("m"), F.col("l")).alias("fault"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def primary_slice(spark: SparkSession, d: str) -> DataFrame:
    """The nations of a region; another number than five would be an error."""
    return C.primary_slice(table(spark, d, "nation"), F.col("n_regionkey") == 1, 5).select("n_nationkey", "n_name")


_FAM_SQL = "SELECT n_name AS entity, CASE WHEN n_nationkey % 6 <> 5 THEN r_name END AS family, CASE WHEN n_nationkey % 6 <> 5 THEN left(r_name, 2) END AS label, CASE WHEN n_nationkey % 6 <> 5 THEN r_name IN ('ASIA', 'EUROPE') END AS is_medical FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_FAM_SQL)
def family_labels(spark: SparkSession, d: str) -> DataFrame:
    """Entities, their families and short labels; no family, no label."""
    n = table(spark, d, "nation")
    fam = n.where("n_nationkey % 6 <> 5").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("family"))
    names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    return C.family_labels(n.select(F.col("n_name").alias("entity")), fam, {x: x[:2] for x in names}, ["ASIA", "EUROPE"])


@query("SELECT text, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'approved by customer ' || o_custkey || ' on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'not approved' END AS text FROM orders) GROUP BY 1")
def approvals(spark: SparkSession, d: str) -> DataFrame:
    """Sign-off lines: finished orders are signed by their customer on their day, others by nobody."""
    done = F.col("o_orderstatus") == "F"
    by, on = F.when(done, F.concat(F.lit("customer "), F.col("o_custkey"))), F.when(done, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select(C.approval(by, on).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{DETECTION}, sj AS (SELECT series_id, max(dist) AS self_match_max FROM (SELECT q.series_id, q.start, min({DIST}) AS dist FROM zw q JOIN zw f USING (series_id) JOIN l USING (series_id) WHERE abs(q.start - f.start) > 2 GROUP BY ALL) GROUP BY 1)
SELECT sc.series_id, round(max(CASE WHEN idx >= s0 - w AND idx < s1 + w THEN score END), 6) AS support_max, round(max(self_match_max), 6) AS self_match_max, round(quantile_cont(CASE WHEN idx < te THEN score END, 0.99), 6) AS train_p99 FROM sc JOIN l USING (series_id) LEFT JOIN sj ON sj.series_id = sc.series_id GROUP BY 1""")
def score_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Largest scores of the profile about the interval, of the profile against the whole series, and the training tail."""
    s, lay = A.series(spark, d).select("series_id", "idx", "x"), A.layouts(spark, d)
    own = P.matrix_profile(s, lay, mode="self_join").select("series_id", F.col("dist").alias("score"))
    return _r6(C.score_diagnostics(P.pad(P.matrix_profile(s, lay), lay), own, lay), "support_max", "self_match_max", "train_p99")


@query(f"WITH {A.S_SQL}, {A.L_SQL} SELECT 'level' AS detector, count(*) AS n, round(sum(x), 6) AS total FROM s JOIN l USING (series_id) UNION ALL SELECT 'flat', count(*), 0.0 FROM s JOIN l USING (series_id)")
def detector_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Detectors by name over the same series."""
    named = {"level": lambda s, l: s.join(l.select("series_id"), "series_id").select("series_id", "idx", F.col("x").alias("score")), "flat": lambda s, l: s.join(l.select("series_id"), "series_id").select("series_id", "idx", F.lit(0.0).alias("score"))}
    s, lay = A.series(spark, d), A.layouts(spark, d)
    out = B.union_all(*[C.dispatch(named, n, s, lay) for n in named])
    return _r6(out.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")), "total")


@query(f"WITH {A.S_SQL}, {A.L_SQL}, p AS (SELECT series_id, start + k AS idx, v FROM (SELECT s.series_id, idx AS start, x AS v, unnest(range(0, 6)) AS k FROM s JOIN l USING (series_id) WHERE idx <= n - w)) SELECT series_id, idx, round(avg(v), 6) AS score FROM p GROUP BY ALL")
def window_scores_to_points(spark: SparkSession, d: str) -> DataFrame:
    """Window scores averaged over the windows that hold a point."""
    lay = A.layouts(spark, d)
    win = A.series(spark, d).join(lay.select("series_id", "n", "w"), "series_id").where("idx <= n - w").select("series_id", F.col("idx").alias("start"), F.col("x").alias("score"))
    return _r6(C.mean_of_windows(win, lay), "score")


@query(f"WITH {A.S_SQL}, {A.L_SQL}, p AS (SELECT series_id, any_value(n) AS n, list(x ORDER BY idx) FILTER (WHERE series_id % 2 = 0 OR idx < te) AS xs FROM s JOIN l USING (series_id) GROUP BY 1), k AS (SELECT *, unnest(range(0, n)) AS j FROM p), f AS (SELECT series_id, n, j, xs, CASE WHEN len(xs) = n THEN j::DOUBLE ELSE j * (len(xs) - 1) / greatest(1, n - 1)::DOUBLE END AS ps FROM k) SELECT series_id, j AS idx, round(xs[floor(ps)::BIGINT + 1] + (xs[least(floor(ps)::BIGINT + 1, len(xs) - 1) + 1] - xs[floor(ps)::BIGINT + 1]) * (ps - floor(ps)), 5) AS score FROM f")
def fitted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every second series are too few and are brought to its length."""
    lay = A.layouts(spark, d)
    sc = A.series(spark, d).join(lay.select("series_id", "te"), "series_id").where("series_id % 2 = 0 OR idx < te").select("series_id", "idx", F.col("x").alias("score"))
    return C.fitted_to_length(sc, lay).select("series_id", "idx", F.round("score", 5).alias("score"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.R_SQL}, u AS (SELECT s.series_id, idx, x, stddev_pop(x) OVER (PARTITION BY s.series_id) AS sd, idx >= a AND idx < b AS inside, ('0x' || substr(md5('7:' || s.series_id || ':' || idx || ':a'), 1, 12))::BIGINT / 281474976710656.0 AS u1, ('0x' || substr(md5('7:' || s.series_id || ':' || idx || ':b'), 1, 12))::BIGINT / 281474976710656.0 AS u2 FROM s JOIN r USING (series_id)) SELECT series_id, idx, round(x + CASE WHEN inside THEN 0.1 * sd * sqrt(-2.0 * ln(1.0 - u1)) * cos(6.283185307179586 * u2) ELSE 0.0 END, 6) AS masked FROM u")
def added_noise(spark: SparkSession, d: str) -> DataFrame:
    """Normal noise added inside each region, by seeded hash."""
    inside = (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b"))
    return _r6(C.added_noise(A.points(spark, d), inside).select("series_id", "idx", "masked"), "masked")


@query(f"WITH {A.S_SQL}, sh AS (SELECT series_id, idx, avg((event_type = 'error')::INT) OVER w AS share, count(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), k AS (SELECT series_id, idx, CASE WHEN share = 0 THEN 'normal' WHEN share >= 0.5 THEN 'anomalous' END AS kind FROM sh WHERE c = 4), o AS (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY ('0x' || substr(md5('7:' || series_id || ':' || idx), 1, 12))::BIGINT, idx) AS r FROM k WHERE kind IS NOT NULL) SELECT series_id, idx AS start, kind FROM o WHERE r <= 3")
def pure_windows(spark: SparkSession, d: str) -> DataFrame:
    """Three wholly normal and three mostly labelled windows of each series: the number is the feature."""
    s = A.series(spark, d).withColumn("label", (F.col("event_type") == "error").cast("int"))
    return C.pure_windows(s, 3, w=4)


@query(f"WITH {A.S_SQL}, {A.L_SQL}, c AS (SELECT series_id, greatest(s0 - w + 1, te) AS lo, least(s1 + w - 1, n) AS hi FROM l), k AS (SELECT series_id, hi - lo AS k FROM c) SELECT series_id, k, unnest(['shap', 'ablation', 'smooth']) AS method, unnest([2 * k + 2048, k + 1, 25]) AS samples FROM k")
def explanation_plan(spark: SparkSession, d: str) -> DataFrame:
    """How many model calls each explanation takes."""
    lay = A.layouts(spark, d)
    return C.sample_counts(lay, S.segments(lay))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, dl AS (SELECT series_id, idx % 5 AS seg, x - avg(x) OVER (PARTITION BY series_id) AS delta FROM s), v AS (SELECT series_id, seg, avg(delta) AS v FROM dl GROUP BY ALL) SELECT series_id, seg, round(v, 6) AS value, round(v / nullif(sum(abs(v)) OVER (PARTITION BY series_id), 0), 5) AS share FROM v")
def segment_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Mean signed change of each segment, and its part of the whole."""
    s = A.series(spark, d).select("series_id", (F.col("idx") % 5).alias("seg"), (F.col("x") - F.avg("x").over(Window.partitionBy("series_id"))).alias("delta"))
    out = R.relevance(s, signed=True)
    return out.select("series_id", "seg", r6(F.col("value")).alias("value"), F.round("share", 5).alias("share"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.R_SQL}, w AS (SELECT s.series_id, idx, x AS before, CASE WHEN idx >= a - 5 AND idx < b THEN x + 1 ELSE x END AS after, 80.0 AS threshold, CASE WHEN idx >= a AND idx + 2 <= b THEN 'interior' WHEN idx < b AND idx + 2 > a THEN 'boundary' ELSE 'untouched' END AS class FROM s JOIN r USING (series_id)) SELECT class, count(*) AS n, round(avg(after - before), 6) AS mean_change, count_if(after > threshold AND before <= threshold) AS false_alarms, count_if(after = before) AS exact FROM w GROUP BY 1")
def class_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects of a change by how a window stands to the region."""
    k = F.col("idx")
    p = A.points(spark, d).withColumn("class", S.window_class(k, F.lit(2), F.col("a"), F.col("b") - F.col("a")))
    after = F.when((k >= F.col("a") - 5) & (k < F.col("b")), F.col("x") + 1).otherwise(F.col("x"))
    return _r6(R.class_effects(p.select("class", F.col("x").alias("before"), after.alias("after"), F.lit(80.0).alias("threshold"))), "mean_change")


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), p AS (SELECT user_id AS series_id, 10 * count(*) AS n, coalesce(list(10 * k) FILTER (WHERE event_type = 'error'), []) AS bumps FROM e GROUP BY 1),
x AS (SELECT series_id, bumps, unnest(range(0, n)) AS idx FROM p), y AS (SELECT series_id, idx, len(list_filter(bumps, lambda b: idx >= b AND idx < b + 40)) > 0 AS inside, ('0x' || substr(md5('7:' || idx), 1, 12))::BIGINT / 281474976710656.0 AS u FROM x)
SELECT series_id, idx, round(sin(idx / 20.0::DOUBLE) + (u - 0.5) * 0.1 + CASE WHEN inside THEN 2.5 ELSE 0 END, 6) AS x, inside::INT AS label FROM y""")
def synthetic_series(spark: SparkSession, d: str) -> DataFrame:
    """A made series for each user, ten points an event, with a labelled bump at each error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("k"))
    plans = e.groupBy(F.col("user_id").alias("series_id")).agg((F.count(F.lit(1)) * 10).alias("n"), F.collect_list(F.when(F.col("event_type") == "error", F.col("k") * 10)).alias("bumps"))
    return _r6(R.synthetic_series(plans), "x")


@query("""WITH b AS (SELECT p_brand, min(p_size) AS least, max(p_size) AS most, count(DISTINCT p_type)::INT AS kinds FROM part GROUP BY 1)
SELECT p_brand AS condition, 'forest' AS detector, CASE WHEN least % 2 = 1 THEN most ELSE 100 END AS "window", CASE least % 3 WHEN 0 THEN 'mf' || kinds WHEN 1 THEN 'mf1.0f' ELSE 'none' END AS tag,
CASE least % 3 WHEN 0 THEN 'max_features=' || kinds || ',' WHEN 1 THEN 'max_features=1.0,' ELSE '' END || 'trees=200' || CASE WHEN least % 2 = 1 THEN ',window=' || most ELSE '' END AS settings FROM b""")
def hyperparameters(spark: SparkSession, d: str) -> DataFrame:
    """Settings by brand as a condition: a number of features and a share of them are two variants, some have their own window."""
    given = {}
    for r in table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.countDistinct("p_type").alias("kinds")).collect():  # a row a brand
        given[r.p_brand] = {"trees": 200} | ({"max_features": int(r.kinds)} if r.least % 3 == 0 else {"max_features": 1.0} if r.least % 3 == 1 else {}) | ({"window": r.most} if r.least % 2 else {})
    return C.hyperparameters(spark, given, "forest")


@query("WITH e AS (SELECT vec_id, label % 3 AS op, embedding AS b, list_transform(embedding, lambda v, i: CASE WHEN i > 4 AND i <= len(embedding) // 2 THEN 0.0::FLOAT ELSE v END) AS a FROM embeddings), c AS (SELECT op, list_position(b, list_max(b)) - 1 AS b, list_position(a, list_max(a)) - 1 AS a FROM e) SELECT op, count(*) AS n, count_if(a <> b) AS changed, count_if(a <> b AND a = 0) AS to_zero, count_if(a = 0) AS zero FROM c GROUP BY 1")
def zero_class(spark: SparkSession, d: str) -> DataFrame:
    """Largest entries of vectors before and after a part is zeroed."""
    e = table(spark, d, "embeddings")
    after = F.transform("embedding", lambda v, i: F.when((i >= 4) & (i < F.floor(F.size("embedding") / 2)), F.lit(0.0).cast("float")).otherwise(v))
    return C.zero_class(e.select((F.col("label") % 3).alias("op"), F.col("embedding").alias("before"), after.alias("after")))


_ADM_SQL = "e AS (SELECT series_id, w, len, unnest([{'lo': te + w - 1, 'hi': least(s0 - w, n) - len - w + 1}, {'lo': greatest(s1 + w, te) + w - 1, 'hi': n - len - w + 1}]) AS r FROM (SELECT *, unnest([LENS]) AS len FROM l))"


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {_ADM_SQL.replace('LENS', '2')}, a AS (SELECT series_id, w, unnest(range(r.lo, r.hi + 1)) AS a FROM e WHERE r.hi >= r.lo) SELECT series_id, a, a + 2 AS b, a - w + 1 AS reach_a, a + 2 + w - 1 AS reach_b FROM a")
def footprints(spark: SparkSession, d: str) -> DataFrame:
    """Regions of two points in normal stretches, and how far a change of each reaches."""
    return C.footprints(A.layouts(spark, d), F.lit(2))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {_ADM_SQL.replace('LENS', '1, 2, 4')}, n AS (SELECT series_id, len, least(20, coalesce(sum((r.hi - r.lo) // len + 1) FILTER (WHERE r.hi >= r.lo), 0))::BIGINT AS n FROM e GROUP BY ALL) SELECT series_id, 'normal' AS region, len::BIGINT AS len, n, CASE WHEN n < 10 THEN 'dropped' WHEN n < 20 THEN 'short' ELSE 'full' END AS status FROM n UNION ALL SELECT series_id, 'anomaly', s1 - s0, 1, 'full' FROM l")
def effect_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which regions of each length a series has room for."""
    return C.effect_plan(A.layouts(spark, d), [1, 2, 4], least=10, enough=20)


@query(f"WITH RECURSIVE {A.S_SQL}, c AS (SELECT series_id, idx AS a, row_number() OVER (PARTITION BY series_id ORDER BY ('0x' || substr(md5('7:' || series_id || ':' || idx), 1, 12))::BIGINT, idx) AS r FROM s WHERE event_type <> 'error'), t AS (SELECT DISTINCT series_id, 0::BIGINT AS r, []::BIGINT[] AS taken FROM c UNION ALL SELECT c.series_id, c.r, CASE WHEN len(taken) < 4 AND len(list_filter(taken, lambda y: c.a < y + 5 AND y < c.a + 5)) = 0 THEN list_append(taken, c.a) ELSE taken END FROM t JOIN c ON c.series_id = t.series_id AND c.r = t.r + 1) SELECT series_id, unnest(arg_max(taken, r)) AS a, 5::BIGINT AS len FROM t GROUP BY 1")
def disjoint_regions(spark: SparkSession, d: str) -> DataFrame:
    """Four regions of five points a series in seeded order, none overlapping: the number is the feature."""
    c = A.series(spark, d).where("event_type <> 'error'").select("series_id", F.col("idx").alias("a"), F.lit(5).cast("long").alias("len"))
    return T.disjoint(c, 4)


@query(f"WITH {A.S_SQL}, j AS (SELECT a.series_id, b.idx - a.idx AS lag, a.x AS x, b.x AS y FROM s a JOIN s b ON a.series_id = b.series_id AND b.idx - a.idx BETWEEN 2 AND 12), r AS (SELECT series_id, lag, round(corr(x, y), 6) AS c FROM j GROUP BY ALL HAVING count(*) > 2 AND max(x) > min(x) AND max(y) > min(y)) SELECT series_id, arg_min(lag, {{'a': -c, 'b': lag}})::INT AS period, max(c) AS corr FROM r GROUP BY 1")
def dominant_periods(spark: SparkSession, d: str) -> DataFrame:
    """The lag at which each series is most like itself."""
    return C.dominant_period(A.series(spark, d), 2, 12)


@query("SELECT 3.0::DOUBLE AS a, 0.0::DOUBLE AS b, 2.0::DOUBLE AS c")
def nonnegative_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weights, none below zero, of three measures in a sum made with 3, 0 and 2."""
    f = table(spark, d, "lineitem").select("l_quantity", "l_tax", "l_discount", (F.col("l_quantity") * 3 + F.col("l_discount") * 2).alias("y"))
    a, b, c = T.nnls3(f, ("l_quantity", "l_tax", "l_discount"), "y")
    return spark.createDataFrame([tuple(round(float(v), 4) + 0.0 for v in (a, b, c))], "a double, b double, c double")


# --- operators of series without a query of their own


@query(f"WITH {A.S_SQL}, {A.L_SQL}, k AS (SELECT *, unnest([0.25, 0.5, 1.0]) AS f FROM l) SELECT series_id, f::DOUBLE AS f, greatest(1, floor(f * w + 0.5))::BIGINT AS len, s0 - w + 1 AS reach_a, s1 + w - 1 AS reach_b FROM k")
def region_plan(spark: SparkSession, d: str) -> DataFrame:
    """Region lengths by fractions of w, and how far a change of the interval reaches."""
    a, b = S.influence(F.col("s0"), F.col("s1"), F.col("w"))
    lay = A.layouts(spark, d).withColumn("f", F.explode(F.array(*[F.lit(v) for v in (0.25, 0.5, 1.0)])))
    return lay.select("series_id", "f", N.region_length(F.col("f"), F.col("w")).alias("len"), a.alias("reach_a"), b.alias("reach_b"))


@query(f"WITH {A.S_SQL}, r AS (SELECT series_id, idx AS a, idx + 3 AS b FROM s WHERE event_type = 'error'), w AS (SELECT *, max(b) OVER (PARTITION BY series_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM r), g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY a) AS g FROM w) SELECT series_id, min(a) AS a, max(b) AS b FROM g GROUP BY series_id, g")
def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Intervals after each labelled point, touching ones joined."""
    s = A.series(spark, d).where("event_type = 'error'").groupBy("series_id").agg(F.collect_list(F.struct(F.col("idx").alias("a"), (F.col("idx") + 3).alias("b"))).alias("r"))
    return s.select("series_id", F.explode(S.merge_runs(F.col("r"))).alias("m")).select("series_id", "m.a", "m.b")


@query(f"WITH {A.S_SQL}, p AS (SELECT series_id, list(x ORDER BY idx) AS xs FROM s GROUP BY 1), k AS (SELECT series_id, xs, j, j * (len(xs) - 1) / 9.0::DOUBLE AS ps FROM (SELECT *, unnest(range(0, 10)) AS j FROM p)), f AS (SELECT series_id, j, ps, floor(ps)::BIGINT AS lo, least(floor(ps)::BIGINT + 1, len(xs) - 1) AS hi, xs FROM k) SELECT series_id, j AS idx, round(xs[lo + 1] + (xs[hi + 1] - xs[lo + 1]) * (ps - lo), 5) AS x FROM f")
def resampled(spark: SparkSession, d: str) -> DataFrame:
    """Every series at ten points."""
    return S.unpack(S.resample(S.pack(A.series(spark, d)), 10)).select("series_id", "idx", F.round("x", 5).alias("x"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, g AS (SELECT series_id, unnest([0, 1]) AS seg FROM l), p AS (SELECT g.series_id, seg, CASE seg WHEN 0 THEN 0 ELSE te END AS a, CASE seg WHEN 0 THEN te ELSE n END AS b FROM g JOIN l USING (series_id)) SELECT series_id, unnest(range(a, b)) AS idx, round((seg + 1) * 10.0 / (b - a), 6) AS v FROM p")
def spread_values(spark: SparkSession, d: str) -> DataFrame:
    """Segment values over their points, in equal parts."""
    lay = A.layouts(spark, d)
    segs = lay.select("series_id", F.lit(0).alias("seg"), F.lit(0).cast("long").alias("a"), F.col("te").alias("b")).union(lay.select("series_id", F.lit(1), "te", "n"))
    attr = segs.select("series_id", "seg", ((F.col("seg") + 1) * 10.0).alias("value"))
    return _r6(X.spread_to_points(attr, segs), "v")


@query(f"WITH {A.S_SQL}, {A.L_SQL} SELECT s.series_id, s.idx FROM s JOIN l USING (series_id) WHERE NOT (idx >= s0 AND idx < s1) AND idx >= te")
def outside_region(spark: SparkSession, d: str) -> DataFrame:
    """Points of the test part that the interval doesn't hold."""
    lay = A.layouts(spark, d)
    inside = lay.select("series_id", F.explode(F.expr("sequence(s0, s1 - 1)")).alias("idx"))
    test = A.series(spark, d).join(lay.select("series_id", "te"), "series_id").where("idx >= te").select("series_id", "idx")
    return test.join(inside, ["series_id", "idx"], "left_anti")


@query("WITH u AS (SELECT DISTINCT user_id, dayofyear(ts) AS i FROM events WHERE event_type IN ('error', 'signup', 'click')) SELECT user_id, array_to_string(list(i ORDER BY i), ',') AS idxs FROM u GROUP BY 1")
def united_indices(spark: SparkSession, d: str) -> DataFrame:
    """The sorted union of each user's lists of days, one list a type of event."""
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "signup", "click"))
    lists = e.groupBy("user_id", "event_type").agg(F.collect_list(F.dayofyear("ts")).alias("idxs"))
    return E.united(lists, "user_id", "idxs").select("user_id", F.array_join(F.transform("idxs", lambda x: x.cast("string")), ",").alias("idxs"))


@query("WITH c AS (SELECT o_orderpriority AS k, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL), j AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, m) AS r FROM c) SELECT k, m::INT AS m, n FROM j WHERE r = 1")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The busiest month of each priority, the earliest of equals."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n")).withColumn("_d", -F.col("n"))
    return B.first_rows(c, ["k"], "_d", "m").drop("_d")


@query("WITH a AS (SELECT r_name AS name, r_regionkey AS key, NULL AS balance FROM region UNION ALL SELECT n_name, n_nationkey, NULL FROM nation UNION ALL SELECT s_name, s_suppkey, s_acctbal FROM supplier) SELECT name, key::BIGINT AS key, balance::DOUBLE AS balance FROM a")
def united_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three tables, columns that one lacks NULL."""
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("key"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return B.union_all(r, n, s)


@query("SELECT p_name AS text FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 10) UNION ALL SELECT '... ' || (count(*) - 10) || ' more' FROM part")
def index_overflow(spark: SparkSession, d: str) -> DataFrame:
    """The first ten names and how many more there are: the limit is the feature."""
    return B.index_with_overflow(table(spark, d, "part").withColumnRenamed("p_name", "text"), 10, "p_partkey", text="text")


@query("SELECT n_nationkey, list_filter([CASE WHEN s_name IS NULL THEN 'supplier' END, CASE WHEN n_nationkey % 4 = 0 OR n_name IS NULL THEN 'name' END], lambda y: y IS NOT NULL)::VARCHAR AS missing FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def missing_slots(spark: SparkSession, d: str) -> DataFrame:
    """Required texts that aren't there."""
    from heronry.operators.integrity import missing_slots as slots

    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("supplier"))
    n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").withColumn("name", F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")))
    return slots(n, "n_nationkey", ["supplier", "name"]).withColumn("missing", F.concat(F.lit("["), F.array_join("missing", ", "), F.lit("]")))


@query("SELECT DISTINCT r_name AS region, o_orderpriority AS priority, l_returnflag AS flag FROM region, (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT l_returnflag FROM lineitem)")
def condition_grid(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of regions, priorities and flags, whether they occur or not."""
    from heronry.operators.lifecycle import condition_grid as grid

    axes = {"region": ("region", "r_name"), "priority": ("orders", "o_orderpriority"), "flag": ("lineitem", "l_returnflag")}
    return grid(spark, {a: [r[0] for r in table(spark, d, t).select(c).distinct().collect()] for a, (t, c) in axes.items()})


@query("WITH RECURSIVE j AS (SELECT l_linenumber AS job, round(sum(l_quantity), 2) AS cost, row_number() OVER (ORDER BY round(sum(l_quantity), 2) DESC) AS r FROM lineitem GROUP BY 1), s AS (SELECT 0::BIGINT AS r, [0.0::DOUBLE, 0.0, 0.0] AS load UNION ALL SELECT j.r, list_append(list_sort(load)[2:], list_min(load) + cost) FROM s JOIN j ON j.r = s.r + 1) SELECT round(list_max(load), 2) AS makespan FROM s ORDER BY r DESC LIMIT 1")
def plan_makespan(spark: SparkSession, d: str) -> DataFrame:
    """How long three workers take for jobs dealt out longest first."""
    jobs = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("cost"))
    return T.makespan(jobs, 3).select(F.round("makespan", 2).alias("makespan"))
