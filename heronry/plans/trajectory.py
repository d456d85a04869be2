"""Queries: span logs, retrieval, integrity, voting, selection, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import numeric as N
from heronry.operators import integrity as I
from heronry.operators import trace as T
from heronry.plans import adapters as A
from heronry.plans.registry import query, table

r6 = N.r6
SP = f"WITH {A.SPAN_SQL}"


@query(f"""{SP} SELECT count(DISTINCT trace_id) AS traces, count(*) AS spans, round(sum(absorbed_tokens) / greatest(sum(emitted_tokens), 1)::DOUBLE, 2) AS isolation, round(count_if(kind IN ('control', 'selection')) / nullif(count_if(kind IN ('control', 'selection', 'model')), 0)::DOUBLE, 3) AS control_ratio, count_if(starts_with(name, 'refine:round')) AS retries,
sum(CASE WHEN parent_id IS NULL THEN input_tokens + output_tokens ELSE 0 END)::BIGINT AS tokens, round(sum(CASE WHEN parent_id IS NULL THEN ended_at - started_at ELSE 0 END), 6) AS wall_seconds, max(peak_vram_mb) AS peak_vram_mb FROM sp""")
def trace_report(spark: SparkSession, d: str) -> DataFrame:
    return T.trace_report(A.spans(spark, d))


@query(f"{SP} SELECT component, component_version, count(*) AS n, min(seq) AS first_seq FROM sp WHERE component IS NOT NULL GROUP BY ALL")
def invocations(spark: SparkSession, d: str) -> DataFrame:
    return T.invocations(A.spans(spark, d))


@query(f"""{SP} SELECT trace_id, count(*) AS spans, round(count_if(kind IN ('control', 'selection')) / nullif(count_if(kind IN ('control', 'selection', 'model')), 0)::DOUBLE, 6) AS control_ratio, sum(absorbed_tokens)::BIGINT AS absorbed, sum(emitted_tokens)::BIGINT AS emitted, round(sum(absorbed_tokens) / greatest(sum(emitted_tokens), 1)::DOUBLE, 6) AS isolation, count_if(status <> 'ok') AS failed, round(max(ended_at) - min(started_at), 6) AS duration FROM sp GROUP BY 1""")
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.trajectory_summary(A.spans(spark, d)).withColumns({c: r6(F.col(c)) for c in ("control_ratio", "isolation")})


@query(f"{SP} SELECT component, arg_max(component_version, seq) AS version, count(*) AS calls, sum(CASE WHEN parent_id IS NULL THEN input_tokens + output_tokens ELSE 0 END)::BIGINT AS root_tokens FROM sp WHERE component IS NOT NULL GROUP BY 1")
def system_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.system_summary(A.spans(spark, d))


@query("WITH RECURSIVE " + A.SPAN_SQL + """, an AS (SELECT trace_id, span_id, span_id AS up FROM sp UNION ALL SELECT an.trace_id, an.span_id, sp.parent_id FROM an JOIN sp ON sp.trace_id = an.trace_id AND sp.span_id = an.up WHERE sp.parent_id IS NOT NULL),
t AS (SELECT an.trace_id, up AS span_id, sum(input_tokens + output_tokens)::BIGINT AS tokens, max(peak_vram_mb) AS peak_vram_mb, count(*) AS subtree FROM an JOIN sp ON sp.trace_id = an.trace_id AND sp.span_id = an.span_id GROUP BY ALL) SELECT t.*, round(ended_at - started_at, 6) AS wall_seconds FROM t JOIN sp USING (trace_id, span_id)""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each span and all below it."""
    return T.usage_rollup(A.spans(spark, d))


@query(f"{SP} SELECT task_key, arg_max(chosen, seq) AS chosen FROM sp WHERE kind = 'selection' GROUP BY 1")
def selections(spark: SparkSession, d: str) -> DataFrame:
    return T.selections(A.spans(spark, d))


@query(f"{SP} SELECT trace_id, span_id, name, chosen AS expected FROM sp WHERE kind = 'human' OR status = 'rejected'")
def cases_from_trace(spark: SparkSession, d: str) -> DataFrame:
    return T.cases_from_trace(A.spans(spark, d))


@query(f"{SP}, v AS (SELECT DISTINCT component, component_version AS version FROM sp WHERE component IS NOT NULL), u AS (SELECT DISTINCT component, component_version AS version FROM sp WHERE kind = 'model'), n AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM v) SELECT component, version FROM n ANTI JOIN u USING (component, version) WHERE n > 1")
def retirement(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d).where(F.col("component").isNotNull()).withColumnRenamed("component_version", "version")
    return T.retirement(s, s.where("kind = 'model'"))


@query(f"{SP}, b AS (SELECT DISTINCT component, component_version AS version FROM sp WHERE component IS NOT NULL AND kind = 'human'), a AS (SELECT DISTINCT component, component_version AS version FROM sp WHERE component IS NOT NULL AND kind = 'selection') SELECT count(*) AS before, count(a.version) AS kept, round(coalesce(count(a.version) / nullif(count(*), 0)::DOUBLE, 1), 6) AS survival FROM b LEFT JOIN a USING (component, version)")
def swap_survival(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d).where(F.col("component").isNotNull()).withColumnRenamed("component_version", "version")
    return T.swap_survival(s.where("kind = 'human'"), s.where("kind = 'selection'")).withColumn("survival", r6(F.col("survival")))


@query("SELECT p_brand AS component, max(p_type) AS version FROM part WHERE p_size % 5 <> 0 GROUP BY 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select(F.col("p_brand").alias("component"), F.col("p_type").alias("version"), (F.col("p_size") % 5 == 0).alias("deprecated"))
    return T.latest_version(v)


CASE_SQL = "cs AS (SELECT 'c' || (l_suppkey % 7) AS component, l_returnflag AS expected, CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS output, l_linestatus = 'O' AND l_orderkey % 5 = 0 AS out_of_envelope, l_orderkey % 10 = 0 AS refused, l_linenumber = 7 AND l_orderkey % 3 = 0 AS error, (l_quantity * 10)::BIGINT AS tokens FROM lineitem)"
SCORE_SQL = f"{CASE_SQL}, so AS (SELECT component, count(*) AS n, coalesce(count_if(NOT out_of_envelope AND NOT refused AND output = expected) / nullif(count_if(NOT out_of_envelope), 0)::DOUBLE, 0) AS accuracy, coalesce(count_if(refused AND out_of_envelope) / nullif(count_if(refused), 0)::DOUBLE, 1) AS envelope_precision, count_if(error) AS errors, sum(tokens)::BIGINT AS tokens FROM cs GROUP BY 1)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return T.component_scores(table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 7).alias("component"), F.col("l_returnflag").alias("expected"), F.when(F.col("l_partkey") % 4 == 0, "N").otherwise(F.col("l_returnflag")).alias("output"), ((F.col("l_linestatus") == "O") & (k % 5 == 0)).alias("out_of_envelope"), (k % 10 == 0).alias("refused"), ((F.col("l_linenumber") == 7) & (k % 3 == 0)).alias("error"), (F.col("l_quantity") * 10).cast("long").alias("tokens")))


@query(f"WITH {SCORE_SQL} SELECT component, n, round(accuracy, 6) AS accuracy, round(envelope_precision, 6) AS envelope_precision, errors, tokens FROM so")
def component_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumns({c: r6(F.col(c)) for c in ("accuracy", "envelope_precision")})


@query(f"""WITH {SCORE_SQL}, j AS (SELECT a.component, a.accuracy, a.tokens, b.accuracy AS ia, b.tokens AS it FROM so a LEFT JOIN so b ON b.component = 'c' || (substr(a.component, 2)::INT - 1))
SELECT component, CASE WHEN accuracy < 0.75 THEN 'rollback' WHEN accuracy <= 0.755 THEN 'unjustified' WHEN ia IS NULL THEN 'promote' WHEN accuracy - ia < 0.001 THEN 'keep' WHEN it > 0 AND tokens > 1.5 * it THEN 'keep' ELSE 'promote' END AS decision FROM j""")
def swap_decision(spark: SparkSession, d: str) -> DataFrame:
    """Each component against its predecessor."""
    s = _scores(spark, d)
    old = s.select(F.concat(F.lit("c"), F.substring("component", 2, 9).cast("int") + 1).alias("component"), F.col("accuracy").alias("incumbent_accuracy"), F.col("tokens").alias("incumbent_tokens"))
    j = s.join(old, "component", "left").withColumn("floor", F.lit(0.75)).withColumn("baseline", F.lit(0.755))
    return T.swap_decision(j, min_gain=0.001).select("component", "decision")


@query("WITH v AS (SELECT 'j' || (l_suppkey % 9) AS judge, l_orderkey AS case_id, l_discount >= 0.05 AS passed FROM lineitem), l AS (SELECT o_orderkey AS case_id, o_totalprice > 200000 AS label FROM orders), c AS (SELECT judge, count(*) AS n, avg((passed = label)::INT) AS agreement, count_if(passed AND NOT label) AS false_pass, count_if(NOT passed AND label) AS false_fail FROM v JOIN l USING (case_id) GROUP BY 1) SELECT judge, n, round(agreement, 6) AS agreement, false_pass, false_fail, n >= 30 AND agreement >= 0.5 AS usable FROM c")
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select(F.concat(F.lit("j"), F.col("l_suppkey") % 9).alias("judge"), F.col("l_orderkey").alias("case_id"), (F.col("l_discount") >= 0.05).alias("passed"))
    lab = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") > 200000).alias("label"))
    return T.judge_calibration(v, lab, agreement=0.5).withColumn("agreement", r6(F.col("agreement")))


@query(f"{SP}, h AS (SELECT DISTINCT trace_id FROM sp), p AS (SELECT * FROM (VALUES ('human', 1, true, true), ('model', 2, true, false), ('selection', 1, false, false)) t(role, need, required, halts)), c AS (SELECT trace_id, kind AS role, count(*) AS have FROM sp GROUP BY ALL), j AS (SELECT h.trace_id, p.*, coalesce(have, 0) AS have FROM h CROSS JOIN p LEFT JOIN c USING (trace_id, role)) SELECT trace_id AS case_id, CASE WHEN bool_or(have = 0 AND required AND halts) OR bool_or(have = 0 AND NOT required AND need > 0) THEN 'halted' WHEN bool_or(have < need) THEN 'degraded' ELSE 'full' END AS decision FROM j GROUP BY 1")
def quorum(spark: SparkSession, d: str) -> DataFrame:
    panel = spark.createDataFrame([("human", 1, True, True), ("model", 2, True, False), ("selection", 1, False, False)], "role string, need int, required boolean, halts boolean")
    return T.quorum(panel, A.spans(spark, d).select(F.col("trace_id").alias("case_id"), F.col("kind").alias("role")))


@query(f"{SP}, w AS (SELECT component, seq, sum(input_tokens) OVER (PARTITION BY component ORDER BY seq) AS spent FROM sp WHERE component IS NOT NULL) SELECT component AS node, seq, spent::BIGINT AS spent, (20000 - spent)::BIGINT AS \"left\", spent > 20000 AS over FROM w")
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d).where(F.col("component").isNotNull()).select(F.col("component").alias("node"), "seq", F.col("input_tokens").alias("tokens"))
    return T.budget(s, s.select("node").distinct().withColumn("limit", F.lit(20000)))


@query(f"{SP}, lg AS (SELECT 's' || (trace_id % 30) AS subject, kind AS key, chosen AS value, started_at AS created_at, CASE WHEN span_id % 2 = 0 THEN 5000.0 END AS ttl, seq, CASE WHEN status = 'rejected' AND span_id = 1 THEN 'forget' ELSE 'put' END AS op FROM sp), p AS (SELECT subject, key, max(seq) AS pseq FROM lg WHERE op = 'put' GROUP BY ALL), lt AS (SELECT subject, key, arg_max({{'v': value, 'c': created_at, 't': ttl}}, seq) AS v FROM lg GROUP BY ALL), f AS (SELECT subject, max(seq) AS fseq FROM lg WHERE op = 'forget' GROUP BY 1) SELECT subject, key, lt.v.v AS value FROM lt JOIN p USING (subject, key) LEFT JOIN f USING (subject) WHERE (lt.v.t IS NULL OR 20000.0 - lt.v.c <= lt.v.t) AND (fseq IS NULL OR pseq > fseq)")
def memory_latest(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d)
    log = s.select(F.concat(F.lit("s"), F.col("trace_id") % 30).alias("subject"), F.col("kind").alias("key"), F.col("attributes")["chosen"].alias("value"), F.col("started_at").alias("created_at"), F.when(F.col("span_id") % 2 == 0, F.lit(5000.0)).alias("ttl_seconds"), "seq", F.when((F.col("status") == "rejected") & (F.col("span_id") == 1), "forget").otherwise("put").alias("op"))
    return T.memory_view(log, 20000.0)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn, role FROM r WHERE r <= 2")
def history_lastn(spark: SparkSession, d: str) -> DataFrame:
    """The last two turns of each conversation: the limit is the feature."""
    return T.history(table(spark, d, "conversations").select("conv_id", "turn", "role"), 2, subject="conv_id", order="turn")


@query("WITH e AS (SELECT p_partkey AS seq, p_brand AS input, p_type AS output FROM part WHERE p_size % 3 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY input, output ORDER BY seq) AS r FROM e), f AS (SELECT seq, input, output FROM k WHERE r = 1), g AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, count(*) OVER () AS n FROM f) SELECT seq, input, output, CASE WHEN i <= greatest(1, floor(n * 0.2)) THEN 'eval' ELSE 'train' END AS part FROM g")
def distill_dedup_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("input"), F.col("p_type").alias("output"), (F.col("p_size") % 3 != 0).alias("verified"))
    return T.distill(e).select("seq", "input", "output", "part")


# --- retrieval and claims

STOP = ("the", "and")
Q_SQL = "q AS (SELECT item_id AS query_id, list_transform(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda y: y <> ''), lambda y: y) AS ts FROM benchmark)"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {Q_SQL}, s AS (SELECT query_id, doc_id, list_sum(list_transform(ts, lambda y: (length(lower(text)) - length(replace(lower(text), y, ''))) // length(y)))::BIGINT AS score FROM q CROSS JOIN documents), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0) SELECT query_id, doc_id, score, rn FROM k WHERE rn <= 5")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five documents that hold a question's words most often: the limit is the feature."""
    return I.keyword_topk(table(spark, d, "documents").select("doc_id", "text"), _queries(spark, d), 5)


GOLD_SQL = "gd AS (SELECT o_custkey AS question_id, list(DISTINCT o_orderkey % 20) FILTER (WHERE o_orderstatus = 'F') AS required, list(DISTINCT o_orderkey % 20) FILTER (WHERE o_orderstatus = 'O') AS helpful, list(DISTINCT o_orderkey % 20) FILTER (WHERE o_orderstatus = 'P') AS forbidden, list(DISTINCT o_orderkey % 20) FILTER (WHERE o_totalprice > 150000) AS retrieved FROM orders GROUP BY 1), g2 AS (SELECT question_id, coalesce(required, []) AS required, coalesce(helpful, []) AS helpful, coalesce(forbidden, []) AS forbidden, coalesce(retrieved, []) AS retrieved FROM gd), sg AS (SELECT question_id, len(list_intersect(retrieved, required)) / nullif(len(required), 0)::DOUBLE AS recall, coalesce(len(list_intersect(retrieved, required)) / nullif(len(list_filter(retrieved, lambda y: NOT list_contains(helpful, y))), 0)::DOUBLE, 0) AS precision, len(list_intersect(retrieved, forbidden)) AS n_forbidden, list_sort(list_filter(required, lambda y: NOT list_contains(retrieved, y))) AS missed FROM g2)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 20
    s = lambda c: F.collect_set(F.when(c, k))
    o = F.col("o_orderstatus")
    gold = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("question_id")).agg(s(o == "F").alias("required"), s(o == "O").alias("helpful"), s(o == "P").alias("forbidden"), s(F.col("o_totalprice") > 150000).alias("retrieved"))
    return I.retrieval_scores(gold)


@query(f"WITH {GOLD_SQL} SELECT question_id, round(recall, 6) AS recall, round(precision, 6) AS precision, n_forbidden::INT AS n_forbidden, array_to_string(missed, ',') AS missed FROM sg")
def retrieval_score(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("question_id", r6(F.col("recall")).alias("recall"), r6(F.col("precision")).alias("precision"), "n_forbidden", F.array_join(F.transform("missed", lambda x: x.cast("string")), ",").alias("missed"))


@query(f"WITH {GOLD_SQL} SELECT count(*) AS questions, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, count_if(recall = 1 AND n_forbidden = 0) AS perfect, sum(n_forbidden)::BIGINT AS forbidden_hits, count_if(n_forbidden > 0) AS questions_with_forbidden FROM sg")
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    return I.retrieval_report(_gold(spark, d)).withColumns({c: r6(F.col(c)) for c in ("mean_recall", "mean_precision")})


_WS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[0-9a-z가-힣]+')), lambda y: length(y) > 1)"


@query(f"WITH c AS (SELECT conv_id, turn, {_WS.format(x='text')} AS w FROM conversations), j AS (SELECT a.conv_id, a.turn, a.w AS need, b.w AS have FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT conv_id, turn, len(need) AS n_words, coalesce(len(list_intersect(need, have)) / nullif(len(need), 0)::DOUBLE >= 0.1, false) AS entailed FROM j")
def lexical_entailment(spark: SparkSession, d: str) -> DataFrame:
    """Whether enough words of a turn stand in the turn before."""
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.size(I.word_set(F.col("text"))).cast("long").alias("n_words"), I.entails(F.col("text"), F.col("before"), 0.1).alias("entailed"))


CL_SQL = f"""cl AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 9 WHEN 0 THEN 'Analysts recommend it' WHEN 1 THEN '매출 전망 상향' WHEN 2 THEN 'expected to grow' WHEN 3 THEN '지금 매수 하라' WHEN 4 THEN 'Sales will grow' WHEN 5 THEN 'Hold the stock' WHEN 6 THEN '목표 주가 상향' WHEN 7 THEN '개선을 기대' ELSE 'revenue rose' END AS text,
CASE l_suppkey % 5 WHEN 0 THEN 'measured' WHEN 1 THEN 'derived' WHEN 2 THEN 'projected' WHEN 3 THEN 'advisory' ELSE 'opinion' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS n_support, l_tax > 0.04 AS labeled, CASE WHEN l_discount > 0.04 THEN '2024-01-01' WHEN l_discount > 0.02 THEN '' END AS as_of FROM lineitem),
sd AS (SELECT *, CASE WHEN regexp_matches(text, '{"|".join(I.ADVISORY_WORDING)}', 'i') THEN 'advisory' WHEN regexp_matches(text, '{"|".join(I.PROJECTION_WORDING)}', 'i') THEN 'projected' END AS said FROM cl)"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("l_partkey") % 9, F.col("l_suppkey") % 5
    text = F.lit("revenue rose")
    for n, said in enumerate(("Analysts recommend it", "매출 전망 상향", "expected to grow", "지금 매수 하라", "Sales will grow", "Hold the stock", "목표 주가 상향", "개선을 기대")):
        text = F.when(k == n, said).otherwise(text)
    kind = F.when(s == 0, "measured").when(s == 1, "derived").when(s == 2, "projected").when(s == 3, "advisory").otherwise("opinion")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"), kind.alias("kind"), F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("support"), (F.col("l_tax") > 0.04).alias("labeled"), F.when(F.col("l_discount") > 0.04, "2024-01-01").when(F.col("l_discount") > 0.02, "").alias("as_of"))


@query(f"WITH {CL_SQL} SELECT said, kind, count(*) AS n FROM sd GROUP BY ALL")
def claim_classify(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).groupBy(I.claim_kind(F.col("text")).alias("said"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CL_SQL}, i AS (SELECT id, unnest(list_filter([CASE WHEN kind IN ('measured', 'derived', 'sourced') AND n_support = 0 THEN 'unsupported_fact' END, CASE WHEN kind = 'projected' AND NOT labeled THEN 'unlabeled_projection' END, CASE WHEN kind = 'advisory' THEN 'advisory_output' END,
CASE WHEN said = 'advisory' AND kind <> 'advisory' THEN 'misclassified_advisory' WHEN said = 'projected' AND kind IN ('measured', 'derived', 'sourced') THEN 'misclassified_projection' END, CASE WHEN kind IN ('measured', 'derived', 'sourced') AND coalesce(as_of, '') = '' THEN 'missing_as_of' END], lambda y: y IS NOT NULL)) AS issue FROM sd) SELECT id, issue FROM i""")
def claim_audit(spark: SparkSession, d: str) -> DataFrame:
    return I.claim_audit(_claims(spark, d))


@query("WITH h AS (SELECT count_if(coalesce(l_tax > 0.07, true)) AS a, count_if(l_quantity > 49.5) AS b, count_if(l_discount > 0.2) AS c FROM lineitem), r AS (SELECT unnest([{'rail': 'tax', 'hits': a, 'tolerance': 100}, {'rail': 'quantity', 'hits': b, 'tolerance': 1000000}, {'rail': 'discount', 'hits': c, 'tolerance': 0}], recursive := true) FROM h) SELECT rail, hits::BIGINT AS hits, tolerance::BIGINT AS tolerance, hits > 0 AND hits <= tolerance AS tolerated, (CASE WHEN hits > tolerance THEN hits ELSE 0 END)::BIGINT AS breaches FROM r")
def guardrails(spark: SparkSession, d: str) -> DataFrame:
    return I.guardrails(table(spark, d, "lineitem"), {"tax": (F.col("l_tax") > 0.07, 100), "quantity": (F.col("l_quantity") > 49.5, 1000000), "discount": (F.col("l_discount") > 0.2, 0)})


@query("WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest(list_filter([CASE WHEN NOT coalesce(l_tax <= 0.05, false) THEN 'tax' END, CASE WHEN NOT coalesce(l_quantity < 45, false) THEN 'quantity' END], lambda y: y IS NOT NULL)) AS rule FROM lineitem) SELECT id, rule FROM v")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return I.violations(rows, "id", {"tax": F.col("l_tax") <= 0.05, "quantity": F.col("l_quantity") < 45})


# --- point in time

AS_OF = "1998-06-30"


@query(f"WITH {A.POINT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY published_at DESC, seq) AS r FROM pt WHERE published_at <= DATE '{AS_OF}' AND (restated_at IS NULL OR restated_at <= DATE '{AS_OF}')) SELECT key, value, published_at::VARCHAR AS published_at FROM k WHERE r = 1")
def asof_view(spark: SparkSession, d: str) -> DataFrame:
    return I.as_of_view(A.data_points(spark, d), F.lit(AS_OF).cast("date")).withColumn("published_at", F.col("published_at").cast("string"))


@query("WITH r AS (SELECT o_custkey, o_orderdate + INTERVAL 1 DAY AS t, max(o_totalprice) AS price FROM orders GROUP BY ALL) SELECT o_orderkey, price AS price_asof FROM orders o ASOF LEFT JOIN r ON o.o_custkey = r.o_custkey AND o.o_orderdate >= r.t")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its customer's last one of an earlier day."""
    o = table(spark, d, "orders")
    right = o.groupBy("o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("t")).agg(F.max("o_totalprice").alias("price"))
    return I.as_of_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), right, "o_custkey", "o_orderdate", "t", ["price"]).select("o_orderkey", "price_asof")


@query(f"WITH {A.POINT_SQL}, k AS (SELECT CASE WHEN published_at IS NULL THEN 'unknown_timestamp' WHEN published_at > DATE '{AS_OF}' THEN 'unpublished' WHEN restated_at > DATE '{AS_OF}' THEN 'restated' WHEN period_end > DATE '{AS_OF}' THEN 'future_observation' WHEN published_at < period_end THEN 'future_observation' ELSE 'clean' END AS leak FROM pt) SELECT leak, count(*) AS n FROM k GROUP BY 1")
def pit_leaks(spark: SparkSession, d: str) -> DataFrame:
    leak = F.coalesce(I.leak(F.lit(AS_OF).cast("date")), F.lit("clean"))
    return A.data_points(spark, d).groupBy(leak.alias("leak")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'net_margin' WHEN 1 THEN 'yoy_growth' WHEN 2 THEN 'roe' ELSE 'mystery' END AS metric, o_totalprice AS a, (CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_custkey END)::DOUBLE AS b FROM orders),
v AS (SELECT *, CASE metric WHEN 'net_margin' THEN a / nullif(b, 0) WHEN 'roe' THEN a / nullif(b, 0) WHEN 'yoy_growth' THEN CASE WHEN b > 0 THEN a / b - 1 END END AS rec FROM c), w AS (SELECT *, coalesce(rec, 0) + CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS rep FROM v),
s AS (SELECT metric, CASE WHEN metric = 'mystery' THEN 'unknown_metric' WHEN rec IS NULL THEN 'undefined' WHEN abs(rec - rep) <= greatest(1e-6 * greatest(abs(rec), abs(rep)), 1e-6) THEN 'ok' ELSE 'mismatch' END AS status, abs(rep - rec) AS err FROM w) SELECT metric, status, count(*) AS n, round(max(err), 6) AS max_error FROM s GROUP BY ALL""")
def metric_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Reported metrics against recomputed ones, with errors planted at every 97th key."""
    k, b = F.col("o_orderkey"), F.when(F.col("o_custkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("o_custkey").cast("double"))
    metric = F.when(k % 4 == 0, "net_margin").when(k % 4 == 1, "yoy_growth").when(k % 4 == 2, "roe").otherwise("mystery")
    inputs = F.create_map(*[x for n, v in (("net_income", F.col("o_totalprice")), ("revenue", b), ("equity", b), ("current", F.col("o_totalprice")), ("prior", b)) for x in (F.lit(n), v)])
    c = table(spark, d, "orders").select(k.alias("id"), metric.alias("metric"), inputs.alias("inputs"))
    true = I.recompute(c.withColumn("reported", F.lit(0.0))).select("id", "metric", "inputs", (F.coalesce("recomputed", F.lit(0.0)) + F.when(F.col("id") % 97 == 0, 1.0).otherwise(0.0)).alias("reported"))
    return I.recompute(true).groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"), r6(F.max("error")).alias("max_error"))


# --- voting and selection


@query("WITH c AS (SELECT user_id, event_type, sum(greatest(value - 5, 0)) AS c FROM events GROUP BY ALL) SELECT event_type AS target, round(sum(sqrt(c)), 6) AS score FROM c GROUP BY 1")
def quadratic_vote(spark: SparkSession, d: str) -> DataFrame:
    rv = table(spark, d, "events").select(F.col("user_id").cast("string").alias("reviewer"), F.col("event_type").alias("target"), (F.col("value") - 5).alias("credits"))
    return I.quadratic_votes(rv).select("target", r6(F.col("score")).alias("score"))


@query("WITH m AS (SELECT count(DISTINCT l_suppkey % 11) AS m FROM lineitem), s AS (SELECT l_orderkey AS claim_id, count(DISTINCT CASE WHEN l_discount > 0.03 THEN l_suppkey % 11 END) AS supporters FROM lineitem GROUP BY 1) SELECT claim_id, supporters, round(supporters / m::DOUBLE, 6) AS share, supporters / m::DOUBLE > 0.5 AS passes FROM s, m")
def claim_vote(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").select((F.col("l_suppkey") % 11).alias("model"), F.col("l_orderkey").alias("claim_id"), (F.col("l_discount") > 0.03).alias("supports"))
    return I.claim_votes(b).select("claim_id", "supporters", r6(F.col("share")).alias("share"), "passes")


@query("WITH o AS (SELECT 'm' || l_linenumber AS model, l_orderkey AS k, l_returnflag <> 'A' AS ok FROM lineitem) SELECT a.model AS model_a, b.model AS model_b, count_if(NOT a.ok AND NOT b.ok) AS both_wrong, count_if(NOT a.ok OR NOT b.ok) AS either_wrong, round(coalesce(count_if(NOT a.ok AND NOT b.ok) / nullif(count_if(NOT a.ok OR NOT b.ok), 0)::DOUBLE, 0), 6) AS correlation FROM o a JOIN o b ON a.k = b.k AND a.model < b.model GROUP BY ALL")
def error_correlation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_linenumber")).alias("model"), F.col("l_orderkey").alias("k"), (F.col("l_returnflag") != "A").alias("correct"))
    return I.error_correlation(o).withColumn("correlation", r6(F.col("correlation")))


@query("WITH f AS (SELECT l_orderkey AS seq, list_sort(list(DISTINCT l_suppkey % 6) FILTER (WHERE l_discount > 0.02)) AS src FROM lineitem GROUP BY 1), d AS (SELECT seq, src IS NOT NULL AND row_number() OVER (PARTITION BY src ORDER BY seq) > 1 AS dup FROM f) SELECT dup AS duplicate, count(*) AS n, sum(seq)::BIGINT AS sum_seq FROM d GROUP BY 1")
def join_findings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.collect_set(F.when(F.col("l_discount") > 0.02, (F.col("l_suppkey") % 6).cast("string"))).alias("sources"))
    return I.join_findings(f).groupBy("duplicate").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("sum_seq"))


@query("""WITH RECURSIVE c AS (SELECT s_nationkey AS g, s_suppkey::VARCHAR AS ref, s_nationkey * 3 + s_suppkey % 4 AS fam, 1.0 + s_suppkey % 7 AS cost, (s_suppkey % 5)::DOUBLE AS vram, row_number() OVER (PARTITION BY s_nationkey ORDER BY -(s_acctbal / (1.0 + s_suppkey % 7)), s_suppkey) AS rn FROM supplier),
st AS (SELECT g, 0::BIGINT AS rn, []::VARCHAR[] AS refs, []::BIGINT[] AS fams, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS vram FROM (SELECT DISTINCT g FROM c)
 UNION ALL SELECT st.g, c.rn, CASE WHEN ok THEN list_append(refs, c.ref) ELSE refs END, CASE WHEN ok THEN list_append(fams, c.fam) ELSE fams END, CASE WHEN ok THEN st.cost + c.cost ELSE st.cost END, CASE WHEN ok THEN st.vram + c.vram ELSE st.vram END
 FROM st JOIN c ON c.g = st.g AND c.rn = st.rn + 1, LATERAL (SELECT len(refs) < 3 AND len(list_filter(fams, lambda y: y = c.fam)) < 1 AND st.vram + c.vram <= 8 AND st.cost + c.cost <= 12 AS ok)),
fin AS (SELECT g, arg_max(refs, rn) AS refs FROM st GROUP BY 1) SELECT g AS nation, unnest(refs) AS ref, (generate_subscripts(refs, 1) - 1)::INT AS pick FROM fin""")
def broker_knapsack(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").cast("string").alias("ref"), (F.col("s_nationkey") * 3 + F.col("s_suppkey") % 4).alias("family"), (F.lit(1.0) + F.col("s_suppkey") % 7).alias("cost"), (F.col("s_suppkey") % 5).cast("double").alias("vram_mb"), F.col("s_acctbal").alias("value"))
    return I.broker(c, "nation", team=3, per_family=1, vram=8.0, cost=12.0)
