"""Queries: rates, schedules, several regions, registries and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import numeric as N
from heronry.operators import integrity as I
from heronry.operators import masking as M
from heronry.operators import metrics as X
from heronry.operators import reports as P
from heronry.operators import rollups as R
from heronry.operators import stats as T
from heronry.operators import trace as Q
from heronry.plans import adapters as A
from heronry.plans.detection import AI_SQL, _ai
from heronry.plans.evaluation import BOOT, CELL_SQL, D_SQL, _effects, draw_sql
from heronry.plans.registry import query, table
from heronry.plans.trajectory import AS_OF, CL_SQL, _claims

r6 = N.r6


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in names})


@query("WITH r AS (SELECT l_returnflag AS op, l_linenumber % 3 AS seed, avg((l_linestatus = 'F')::INT) AS r FROM lineitem GROUP BY ALL) SELECT op, count(*) AS seeds, round(min(r), 6) AS least, round(median(r), 6) AS med, round(max(r), 6) AS most FROM r GROUP BY 1")
def rate_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Success rate of each seed, and its range."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("op"), (F.col("l_linenumber") % 3).alias("seed"), "l_linestatus")
    return _r6(R.over_seeds(rows, ["op"], "seed", F.col("l_linestatus") == "F"), "least", "med", "most")


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL} SELECT coalesce(domain, 'all') AS domain, count(*) AS n, min(length) AS least, round(median(length), 6) AS med, max(length) AS most, count_if(length >= 60) AS flagged FROM meta GROUP BY ROLLUP (domain)")
def length_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return _r6(R.range_by(A.meta(spark, d), "domain", "length", F.col("length") >= 60), "med")


@query(f"WITH {AI_SQL} SELECT region, count(ai) AS n, round(median(ai), 6) AS med, round(avg((ai > 0)::INT), 6) AS above FROM ai GROUP BY 1")
def pooled_effects(spark: SparkSession, d: str) -> DataFrame:
    return _r6(R.pooled(_ai(spark, d), ["region"], "ai"), "med", "above")


@query(f"WITH {AI_SQL} SELECT op, 'rate' AS how, round(avg((ai > 0)::INT), 6) AS point FROM ai GROUP BY 1 UNION ALL SELECT op, 'size', round(median(ai), 6) FROM ai GROUP BY 1")
def point_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Means of rates and medians of sizes."""
    ai = _ai(spark, d).withColumn("pos", (F.col("ai") > 0).cast("int"))
    each = [R.point_estimate(ai, ["op"], v, how).select("op", F.lit(how).alias("how"), r6(F.col("point")).alias("point")) for v, how in (("pos", "rate"), ("ai", "size"))]
    return each[0].union(each[1])


@query("SELECT l_linenumber AS fold, count(*) AS n, round(avg((CASE WHEN l_quantity > 25 THEN 'A' ELSE 'N' END = l_returnflag)::INT), 6) AS accuracy FROM lineitem GROUP BY 1")
def fold_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("fold"), F.when(F.col("l_quantity") > 25, "A").otherwise("N").alias("p"), "l_returnflag")
    return _r6(R.accuracy(rows, ["fold"], "p", "l_returnflag"), "accuracy")


@query(f"WITH {A.S_SQL} SELECT series_id, round(min(v), 6) AS least, round(max(v), 6) AS most, bool_and(v = round(v)) AS all_whole FROM (SELECT series_id, CASE WHEN series_id % 4 = 0 THEN floor(x) ELSE x END AS v FROM s) GROUP BY 1")
def value_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of series, and which hold whole numbers only."""
    s = A.series(spark, d).withColumn("v", F.when(F.col("series_id") % 4 == 0, F.floor("x").cast("double")).otherwise(F.col("x")))
    return _r6(R.value_kinds(s, "series_id", "v"), "least", "most")


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL} SELECT domain, variant, count(*) AS n, count(DISTINCT name_group) AS units, count(DISTINCT name_group) < 5 AS small FROM meta GROUP BY ALL")
def subset_counts(spark: SparkSession, d: str) -> DataFrame:
    """Series by domain and variant; small ones are marked."""
    return R.small_counts(A.meta(spark, d), ["domain", "variant"], "name_group", 5)


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.META_SQL}, q AS (SELECT num, length BETWEEN 50 AND 80 AS r2, te >= 20 AS r3, variant = 'plain' AS r4, domain <> 'error' AS r7 FROM meta) SELECT *, r2 AND r3 AND r4 AND r7 AS selected FROM q")
def selection_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules as columns, and what they leave."""
    rules = {"r2": F.col("length").between(50, 80), "r3": F.col("te") >= 20, "r4": F.col("variant") == "plain", "r7": F.col("domain") != "error"}
    return R.selection_rules(A.meta(spark, d), rules).select("num", *rules, "selected")


@query(f"WITH {A.SPAN_SQL} SELECT kind, count(*) AS calls, count_if(status <> 'ok') AS failed, round(avg((status <> 'ok')::INT), 6) AS failure_rate, round(sum(ended_at - started_at), 6) AS seconds FROM sp GROUP BY 1")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d).select("kind", (F.col("status") == "ok").alias("ok"), (F.col("ended_at") - F.col("started_at")).alias("seconds"))
    return _r6(R.failure_summary(s, "kind"), "failure_rate", "seconds")


@query("WITH f AS (SELECT doc_id % 20 AS folder, 'd' || doc_id AS filename, sha256(coalesce(text, '')) AS h FROM documents) SELECT folder, count(*) AS files, sha256(string_agg(h || ' ' || filename, chr(10) ORDER BY filename)) AS sha256 FROM f GROUP BY 1")
def tree_hashes(spark: SparkSession, d: str) -> DataFrame:
    """One hash for each folder of files."""
    f = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("folder"), F.concat(F.lit("d"), "doc_id").alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return R.tree_hash(f, "folder")


@query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier")
def longest_first(spark: SparkSession, d: str) -> DataFrame:
    """The order in which jobs of a group go."""
    return R.longest_first(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", "s_nationkey").select("s_nationkey", "s_suppkey", F.col("turn").cast("long").alias("turn"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_balances(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest: the limit is the feature."""
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", F.round("c_acctbal", 2).alias("balance"))


@query(f"WITH {A.S_SQL} SELECT series_id, idx, round(sum(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS x FROM s")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """Means of five points, zeros beyond the ends."""
    return _r6(R.moving_average(A.series(spark, d), 5), "x")


@query(f"WITH {A.S_SQL}, v AS (SELECT series_id, idx, round(x) AS value, ('0x' || substr(md5('7:' || series_id || ':' || idx), 1, 12))::BIGINT AS tie FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, tie, idx) AS rn, count(*) OVER (PARTITION BY series_id) AS k FROM v) SELECT series_id, idx AS seg, rn, k + 1 - rn AS rn_least FROM o")
def seeded_tie_order(spark: SparkSession, d: str) -> DataFrame:
    """Most relevant first with ties in seeded order; least relevant first is the exact reverse."""
    v = A.series(spark, d).select("series_id", F.col("idx").alias("seg"), F.round("x").alias("value"), N.portable_random(F.lit(7), F.col("series_id"), F.col("idx")).alias("tie"))
    return X.order_segments(v).select("series_id", "seg", F.col("rn").cast("long").alias("rn"), F.col("rn_least").cast("long").alias("rn_least"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, a AS (SELECT series_id, idx AS lo, idx + 4 AS hi FROM s WHERE event_type = 'signup'), b AS (SELECT series_id, s0 - 2 AS lo, s1 AS hi FROM l) SELECT a.series_id, a.lo AS a0, a.hi AS a1, b.lo AS b0, b.hi AS b1 FROM a JOIN b ON a.series_id = b.series_id AND a.lo < b.hi AND b.lo < a.hi")
def overlapping_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that share a point with a series' labelled one."""
    a = A.series(spark, d).where("event_type = 'signup'").select("series_id", F.col("idx").alias("lo"), (F.col("idx") + 4).alias("hi"))
    return R.overlapping(a, A.layouts(spark, d).select("series_id", (F.col("s0") - 2).alias("lo"), F.col("s1").alias("hi")))


@query(f"WITH {A.S_SQL}, {A.L_SQL} SELECT l.series_id, count(*) AS n, count_if((idx < te)::INT + (idx >= s0 AND idx < s1)::INT + (idx >= te AND NOT (idx >= s0 - 1 AND idx < s1))::INT <> 1) AS faults FROM s JOIN l USING (series_id) GROUP BY 1")
def partition_faults(spark: SparkSession, d: str) -> DataFrame:
    """Points that are in no part of a layout, or in several: one a series, as the normal part begins one late."""
    i = F.col("idx")
    p = A.series(spark, d).join(A.layouts(spark, d), "series_id")
    return R.partition_faults(p, "series_id", {"train": i < F.col("te"), "gt": (i >= F.col("s0")) & (i < F.col("s1")), "normal": (i >= F.col("te")) & ~((i >= F.col("s0") - 1) & (i < F.col("s1")))})


@query("SELECT conv_id, turn, left(trim(text, ' '), 40) AS excerpt, (length(text) // 4)::BIGINT AS tokens FROM conversations")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of each turn, and about how many tokens it has."""
    return table(spark, d, "conversations").select("conv_id", "turn", R.excerpt(F.col("text"), 40).alias("excerpt"), F.floor(F.char_length("text") / 4).alias("tokens"))


_RUNS_SQL = "rn AS (SELECT series_id, te + 2 AS a, te + 5 AS b FROM l UNION ALL SELECT series_id, s0, s1 FROM l)"


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {_RUNS_SQL}, e AS (SELECT rn.series_id, a, b, max(CASE WHEN idx = a - 1 THEN x END) AS lf, max(CASE WHEN idx = b THEN x END) AS rt, avg(x) AS mean FROM rn JOIN s USING (series_id) GROUP BY ALL), m AS (SELECT s.series_id, idx, coalesce(coalesce(lf, rt) + (coalesce(rt, lf) - coalesce(lf, rt)) * (idx - a + 1) / (b - a + 1)::DOUBLE, mean) AS m FROM s JOIN e ON s.series_id = e.series_id AND idx >= a AND idx < b) SELECT s.series_id, s.idx, round(coalesce(m, x), 4) AS masked FROM s JOIN l USING (series_id) LEFT JOIN m ON m.series_id = s.series_id AND m.idx = s.idx")
def masked_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two regions of each series bridged, each from the values as they were."""
    lay = A.layouts(spark, d)
    runs = lay.select("series_id", (F.col("te") + 2).alias("a"), (F.col("te") + 5).alias("b")).union(lay.select("series_id", "s0", "s1"))
    points = A.series(spark, d).join(lay, "series_id")
    return R.mask_runs(points, runs, "linear").select("series_id", "idx", F.round("masked", 4).alias("masked"))


@query(f"WITH {A.S_SQL}, {A.L_SQL}, g AS (SELECT *, n - 3 AS a, n AS b FROM l), e AS (SELECT series_id, any_value(a) AS a, any_value(b) AS b, avg(CASE WHEN idx < te THEN x END) AS mean, max(CASE WHEN idx = a - 1 THEN x END) AS lf FROM s JOIN g USING (series_id) GROUP BY 1) SELECT s.series_id, idx, round(CASE WHEN idx >= a THEN lf + (mean - lf) * (idx - a + 1) / (b - a + 1)::DOUBLE ELSE x END, 10) AS masked FROM s JOIN e USING (series_id)")
def bridged_edges(spark: SparkSession, d: str) -> DataFrame:
    """A region at the end of each series: the line goes to the training mean. What lies outside is checked to be as it was."""
    lay = A.layouts(spark, d).withColumn("a", F.col("n") - 3).withColumn("b", F.col("n"))
    return R.erased(R.linear_from_mean(A.series(spark, d).join(lay, "series_id"))).select("series_id", "idx", F.round("masked", 10).alias("masked"))  # ten places: values end before, so none lies between two


@query(f"WITH {A.S_SQL}, {A.L_SQL}, {A.R_SQL}, p AS (SELECT s.series_id, max(CASE WHEN idx > a - w AND idx < b + w THEN x END) AS before, max(CASE WHEN idx > a - w AND idx < b + w THEN CASE WHEN idx >= a AND idx < b THEN 0.0 ELSE x END END) AS after, stddev_pop(CASE WHEN idx < te THEN x END) AS sd FROM s JOIN r USING (series_id) GROUP BY 1) SELECT series_id, round(before, 6) AS before, round(after, 6) AS after, round((after - before) / nullif(sd, 0), 6) AS ai FROM p")
def response_change(spark: SparkSession, d: str) -> DataFrame:
    """How far a region's largest score moves when it is zeroed."""
    score = lambda df, c: df.select("series_id", "idx", F.col(c).alias("score"))
    p = M.mask(A.points(spark, d), "zero")
    return _r6(R.response_change(score(p, "x"), score(p, "masked"), A.regions(spark, d)), "before", "after", "ai")


@query(f"""WITH {D_SQL}, {draw_sql('dw', 'dd', BOOT)}, st AS (SELECT b, op, avg(v) AS m, median(v) AS q FROM dw JOIN dd USING (unit) GROUP BY ALL), ci AS (SELECT op, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, quantile_cont(q, 0.025) AS mlo, quantile_cont(q, 0.975) AS mhi FROM st GROUP BY 1)
SELECT op, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mlo, 6) AS med_lo, round(mhi, 6) AS med_hi, CASE WHEN lo > 0 THEN 'GO' WHEN hi < 0 THEN 'NO-GO' ELSE 'undecided' END AS verdict FROM ci""")
def interval_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of means and medians, and whether the means decide."""
    e = _effects(spark, d)
    drawn = T.draws(spark, e, BOOT)
    mean = T.bootstrap(e, drawn, ["op"], F.avg("v")).select("op", "lo", "hi")
    med = T.bootstrap(e, drawn, ["op"], F.median("v")).select("op", F.col("lo").alias("med_lo"), F.col("hi").alias("med_hi"))
    return _r6(mean.join(med, "op").withColumn("verdict", R.gate_verdict(F.col("lo"), F.col("hi"))), "lo", "hi", "med_lo", "med_hi")


@query(f"WITH {A.S_SQL}, c AS (SELECT series_id, quantile_cont(x, 0.8) AS cut, sum((event_type = 'error')::INT) AS n1 FROM s GROUP BY 1), j AS (SELECT s.series_id, idx, event_type = 'error' AS lb, event_type = 'error' AND x >= cut AS bo, n1 FROM s JOIN c USING (series_id)), k AS (SELECT *, sum(bo::INT) OVER (PARTITION BY series_id) AS n2 FROM j) SELECT series_id, idx, round(coalesce(lb::INT / nullif(n1, 0)::DOUBLE, 0), 6) AS o1, round(CASE WHEN n2 > 0 THEN bo::INT / n2::DOUBLE ELSE coalesce(lb::INT / nullif(n1, 0)::DOUBLE, 0) END, 6) AS o2 FROM k")
def achievable_targets(spark: SparkSession, d: str) -> DataFrame:
    """Even weight on labelled points, and on those of them with a high score."""
    s = A.series(spark, d).select("series_id", "idx", F.col("x").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    return _r6(R.achievable(s, share=0.2), "o1", "o2")


@query(f"WITH {A.POINT_SQL} SELECT key, bool_or(coalesce(published_at <= DATE '{AS_OF}' AND (restated_at IS NULL OR restated_at <= DATE '{AS_OF}'), false)) AS available FROM pt GROUP BY 1")
def availability(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are known at a date, and those withheld."""
    return R.availability(A.data_points(spark, d), F.lit(AS_OF).cast("date"))


@query(f"WITH {A.POINT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY published_at DESC, seq) AS r FROM pt WHERE published_at <= DATE '{AS_OF}' AND (restated_at IS NULL OR restated_at <= DATE '{AS_OF}')) SELECT key, round(value, 2) AS value FROM k WHERE r = 1 AND key % 2 = 0")
def required_points(spark: SparkSession, d: str) -> DataFrame:
    """The values of required keys; one that isn't known would be an error."""
    view = I.as_of_view(A.data_points(spark, d), F.lit(AS_OF).cast("date"))
    return R.required_at(view, view.where("key % 2 = 0").select("key")).select("key", F.round("value", 2).alias("value"))


@query("WITH v AS (SELECT p_brand AS component, p_type AS version, min(p_size) AS rung, count(*) AS uses FROM part GROUP BY ALL) SELECT component, left(component, 7) AS role, count(*) AS versions, max(version) AS last, sum(uses)::BIGINT AS uses, bool_or(rung % 9 >= 6) AS parametric FROM v GROUP BY 1")
def registry_report(spark: SparkSession, d: str) -> DataFrame:
    """Registered components: versions, uses, and which are parametric."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("component"), F.col("p_type").alias("version"), F.left("p_brand", F.lit(7)).alias("role"), "p_size")
    return R.registry_report(p.groupBy("component", "version", "role").agg((F.min("p_size") % 9).alias("rung")), p.select("component"))


@query("WITH r AS (SELECT l_suppkey % 7 AS component, l_linenumber AS version, max(l_orderkey * 10 + l_linenumber) AS seq, avg((l_linestatus = 'F')::INT) AS accuracy, avg((l_tax < 0.05)::INT) AS coverage FROM lineitem GROUP BY ALL) SELECT component, arg_max(version, seq) AS version, round(arg_max(accuracy, seq), 6) AS accuracy, round(arg_max(coverage, seq), 6) AS coverage, arg_max(accuracy, seq) >= 0.5 AS passes FROM r GROUP BY 1")
def component_board(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each component's board against a floor."""
    l = table(spark, d, "lineitem").withColumn("component", F.col("l_suppkey") % 7).groupBy("component", F.col("l_linenumber").alias("version"))  # noqa: E741
    records = l.agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.avg((F.col("l_linestatus") == "F").cast("double")).alias("accuracy"), F.avg((F.col("l_tax") < 0.05).cast("double")).alias("coverage"))
    return _r6(R.board(records, floor=0.5), "accuracy", "coverage")


@query("WITH v AS (SELECT l_suppkey % 9 AS judge, l_orderkey AS case_id, l_discount >= 0.05 AS passed, l_linenumber FROM lineitem), c AS (SELECT judge, count(*) AS n, avg((passed = (o_totalprice > 200000))::INT) AS agreement FROM v JOIN orders ON o_orderkey = case_id GROUP BY 1) SELECT v.judge, count(*) AS cases, count(CASE WHEN agreement >= 0.5 AND n >= 30 THEN passed END) AS given FROM v JOIN c USING (judge) GROUP BY 1")
def calibrated_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of judges that may be used; others give none."""
    v = table(spark, d, "lineitem").select((F.col("l_suppkey") % 9).alias("judge"), F.col("l_orderkey").alias("case_id"), (F.col("l_discount") >= 0.05).alias("passed"))
    lab = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") > 200000).alias("label"))
    return R.judged(v, Q.judge_calibration(v, lab, agreement=0.5)).groupBy("judge").agg(F.count(F.lit(1)).alias("cases"), F.count("verdict").alias("given"))


@query("SELECT p_brand AS component, count(*) AS n, count_if(p_size % 3 <> 0) AS verified, round(count_if(p_size % 3 <> 0) / count(*)::DOUBLE, 6) AS ratio FROM part GROUP BY 1")
def verified_ratios(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("component"), (F.col("p_size") % 3 != 0).alias("verified"))
    return _r6(R.verified_ratio(p, "component"), "ratio")


@query("WITH e AS (SELECT p_brand AS component, count(*) >= 8 AS eligible FROM part GROUP BY 1), f AS (SELECT DISTINCT p_brand AS component FROM part WHERE p_size > 45) SELECT component, eligible AND f.component IS NOT NULL AS publishable, CASE WHEN NOT eligible THEN 'entry' WHEN f.component IS NULL THEN 'no_fallback' END AS why FROM e LEFT JOIN f USING (component)")
def publishable_components(spark: SparkSession, d: str) -> DataFrame:
    """Which distilled components may be published, and why others may not."""
    p = table(spark, d, "part").withColumnRenamed("p_brand", "component")
    return R.publishable(p.groupBy("component").agg((F.count(F.lit(1)) >= 8).alias("eligible")), p.where("p_size > 45"))


@query("SELECT s_nationkey, count(DISTINCT s_suppkey % 4) AS families, count(DISTINCT s_suppkey % 4) >= 3 AS diverse FROM supplier GROUP BY 1")
def panel_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Whether a panel has enough families."""
    return R.diverse(table(spark, d, "supplier").withColumn("f", F.col("s_suppkey") % 4), "s_nationkey", "f", 3)


@query("WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS score, min(c_custkey) AS seq FROM customer GROUP BY ALL) SELECT c_nationkey, arg_max(c_mktsegment, {'a': score, 'b': -seq}) AS c_mktsegment FROM s GROUP BY 1")
def vote_winners(spark: SparkSession, d: str) -> DataFrame:
    """The largest segment of each nation, the first of equals."""
    s = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("score"), F.min("c_custkey").alias("seq"))
    return R.winner(s, "c_nationkey", "c_mktsegment", "seq")


@query(f"WITH {CL_SQL} SELECT kind IN ('measured', 'derived', 'sourced') AS verifiable, count(*) AS n, count_if(labeled) AS labeled FROM sd GROUP BY 1")
def verifiable_split(spark: SparkSession, d: str) -> DataFrame:
    """Claims that can be verified, apart from the rest."""
    c = _claims(spark, d)
    return c.groupBy(F.col("kind").isin(*I.VERIFIABLE).alias("verifiable")).agg(F.count(F.lit(1)).alias("n"), F.count_if("labeled").alias("labeled"))


@query(f"WITH {CELL_SQL} SELECT op, round(max(CASE WHEN am = 'am0' THEN cmi END), 6) AS am0, round(max(CASE WHEN am = 'am1' THEN cmi END), 6) AS am1, round(max(CASE WHEN am = 'am2' THEN cmi END), 6) AS am2, round(max(CASE WHEN am = 'am3' THEN cmi END), 6) AS am3 FROM cm GROUP BY 1")
def cmi_table(spark: SparkSession, d: str) -> DataFrame:
    """CMI of each operator and method, methods as columns."""
    from heronry.operators.tables import pivot_strict

    names = ["am0", "am1", "am2", "am3"]
    return _r6(pivot_strict(X.cell_summary(_effects(spark, d), ["op", "am"], "v"), "op", "am", "cmi", names), *names)


@query(f"WITH {CELL_SQL}, k AS (SELECT op, am, round(cmi, 9) AS c FROM cm), rk AS (SELECT op, am, rank() OVER (PARTITION BY op ORDER BY c DESC) + (count(*) OVER (PARTITION BY op, c) - 1) / 2.0::DOUBLE AS rank FROM k), s AS (SELECT am, sum(rank) AS s, count(DISTINCT op) AS m FROM rk GROUP BY 1) SELECT max(m) AS raters, count(*) AS items, round(12.0 * var_pop(s) * count(*) / (max(m) * max(m) * (count(*) * count(*) * count(*) - count(*))), 6) AS w FROM s")
def cmi_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Concordance of operators' rankings by CMI."""
    c = X.cell_summary(_effects(spark, d), ["op", "am"], "v").withColumn("c", F.round("cmi", 9))
    return _r6(P.concordance(c.withColumn("rank", N.average_rank(F.col("c"), ["op"])), [], "op", "am"), "w")


@query(f"WITH {AI_SQL}, t AS (SELECT series_id, op, max(CASE WHEN region = 'anomaly' THEN ai END) AS an, median(CASE WHEN region = 'sar_normal' THEN abs(ai) END) AS den, count(CASE WHEN region = 'sar_normal' THEN abs(ai) END) AS np FROM ai GROUP BY ALL), s AS (SELECT op, an > 0 AS rev, coalesce(den < 1e-6, false) AS dz, np < 5 AS ex, CASE WHEN NOT coalesce(den < 1e-6, false) AND np >= 5 AND an IS NOT NULL THEN abs(an) / den END AS v FROM t) SELECT op, flagged, count(v) AS n, round(median(v), 6) AS med, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(avg(rev::INT), 6) AS reversals, count_if(dz) AS zero_dens FROM (SELECT *, 'all' AS flagged FROM s UNION ALL SELECT *, 'reversal' FROM s WHERE rev) GROUP BY ALL")
def sar_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of anomaly effects by operator, over all series and over those with a reversal."""
    s = X.sar_table(_ai(spark, d))
    both = s.withColumn("flagged", F.lit("all")).union(s.where("reversal").withColumn("flagged", F.lit("reversal")))
    out = both.groupBy("op", "flagged").agg(F.count("sar_abs").alias("n"), F.median("sar_abs").alias("med"), (F.percentile("sar_abs", F.lit(0.75)) - F.percentile("sar_abs", F.lit(0.25))).alias("iqr"), F.avg(F.col("reversal").cast("int")).alias("reversals"), F.count_if("den_zero").alias("zero_dens"))
    return _r6(out, "med", "iqr", "reversals")


@query(f"WITH {A.S_SQL}, c AS (SELECT series_id, idx, max(x) OVER w = min(x) OVER w AS flat, count(*) OVER w AS k FROM (SELECT series_id, idx, CASE WHEN series_id % 3 = 0 THEN 1.0 ELSE round(x / 40) END AS x FROM s) WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT count_if(n > 0) AS series_with, max(n)::BIGINT AS most, round(median(n), 6) AS med FROM (SELECT series_id, count_if(flat AND k = 4) AS n FROM c GROUP BY 1)")
def constant_window_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many series hold constant windows of four points, and how many of them."""
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(0, 3)
    s = A.series(spark, d).withColumn("x", F.when(F.col("series_id") % 3 == 0, 1.0).otherwise(F.round(F.col("x") / 40)))
    n = s.withColumn("flat", F.max("x").over(w) == F.min("x").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).groupBy("series_id").agg(F.count_if(F.col("flat") & (F.col("k") == 4)).alias("n"))
    return _r6(n.agg(F.count_if(F.col("n") > 0).alias("series_with"), F.max("n").alias("most"), F.median("n").alias("med")), "med")
