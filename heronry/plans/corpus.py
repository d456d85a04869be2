"""Queries: corpora, skills, budgets, verification signals, control patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import r6
from heronry.operators import corpus as C
from heronry.operators import integrity as I
from heronry.operators import lifecycle as L
from heronry.operators import trace as T
from heronry.plans import adapters as A
from heronry.plans.registry import query, table
from heronry.plans.trajectory import AS_OF, CL_SQL, GOLD_SQL, _claims, _gold, _queries

SP = f"WITH {A.SPAN_SQL}"


# --- documents

_LOG_SQL = "lg AS (SELECT conv_id * 100 + turn AS seq, conv_id % 60 AS doc_id, CASE WHEN turn = 7 AND conv_id = 50 THEN 'forget' WHEN turn % 4 = 3 THEN 'remove' ELSE 'add' END AS op, text FROM conversations), wp AS (SELECT coalesce(max(seq), -1) AS w FROM lg WHERE op = 'forget'), cs AS (SELECT doc_id, arg_max({'seq': seq, 'op': op, 'text': text}, seq) AS v FROM lg WHERE op <> 'forget' GROUP BY 1), st AS (SELECT doc_id, v.text AS text FROM cs, wp WHERE v.op = 'add' AND v.seq > w)"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    op = F.when((t == 7) & (c == 50), "forget").when(t % 4 == 3, "remove").otherwise("add")
    return C.corpus_state(table(spark, d, "conversations").select((c * 100 + t).alias("seq"), (c % 60).alias("doc_id"), op.alias("op"), "text"))


@query(f"WITH {_LOG_SQL} SELECT doc_id, text FROM st")
def corpus_state(spark: SparkSession, d: str) -> DataFrame:
    """What a corpus holds after its log of additions, removals and a forgetting."""
    return _corpus(spark, d)


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[0-9a-z가-힣]+')), lambda y: length(y) > 1)"


@query(f"WITH {_LOG_SQL}, w AS (SELECT doc_id, unnest({_WORDS.format(x='text')}) AS word FROM st) SELECT word, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY 1")
def corpus_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return C.vocabulary(_corpus(spark, d))


@query(f"{SP}, c AS (SELECT DISTINCT word FROM (SELECT unnest({_WORDS.format(x='text')}) AS word FROM benchmark)), q AS (SELECT trace_id AS question_id, any_value(text) AS question, CASE WHEN trace_id % 9 = 0 THEN 'free' END AS mode, (trace_id % 10) / 10.0 AS confidence FROM sp WHERE span_id = 0 GROUP BY trace_id), h AS (SELECT question_id, bool_or(w IN (SELECT word FROM c)) AS hit FROM (SELECT question_id, unnest({_WORDS.format(x='question')}) AS w FROM q) GROUP BY 1) SELECT question_id, CASE WHEN confidence < 0.2 THEN 'fallback' ELSE coalesce(mode, CASE WHEN coalesce(hit, false) THEN 'grounded' ELSE 'free' END) END AS route FROM q LEFT JOIN h USING (question_id)")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    """Where each conversation's first turn goes: its own mode, grounded if the corpus knows a word, or free."""
    k = F.col("trace_id")
    q = A.spans(spark, d).where("span_id = 0").select(k.alias("question_id"), F.col("text").alias("question"), F.when(k % 9 == 0, "free").alias("mode"), ((k % 10) / F.lit(10.0)).alias("confidence"))
    words = table(spark, d, "benchmark").select(F.explode(I.word_set(F.col("text"))).alias("word")).distinct()
    return I.route(q, words, least=0.2)


@query("SELECT o_orderkey, o_orderstatus <> 'P' AND (o_orderkey % 7 = 0 OR o_custkey % 2 = 0 OR o_orderkey % 5 = 0) AS degraded FROM orders")
def degraded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that could be checked and fell short."""
    k = F.col("o_orderkey")
    a = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("verifiable"), (k % 7 == 0).alias("blocked"), (F.col("o_custkey") % 2 != 0).alias("grounded"), F.when(k % 5 == 0, F.array(F.lit("as_of"))).alias("missing"))
    return C.degraded(a).select("o_orderkey", "degraded")


@query("WITH b AS (SELECT l_orderkey AS answer_id, l_linenumber AS pos, unnest(list_filter([CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_quantity > 45 THEN 'quantity' END], lambda y: y IS NOT NULL)) AS rule FROM lineitem) SELECT answer_id, rule, array_to_string(list_sort(list(DISTINCT pos)), ',') AS claims FROM b GROUP BY ALL")
def breach_index(spark: SparkSession, d: str) -> DataFrame:
    """Which claims of an answer break each rule."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), "l_tax", "l_quantity")
    broken = I.violations(rows, "claim_id", {"tax": F.col("l_tax") <= 0.05, "quantity": F.col("l_quantity") <= 45}).withColumn("answer_id", F.floor(F.col("claim_id") / 10))
    return C.breach_index(broken, rows).withColumn("claims", F.array_join(F.transform("claims", lambda x: x.cast("string")), ","))


@query("WITH q AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda y: y <> '') AS ts FROM benchmark), s AS (SELECT query_id, doc_id, text, list_sum(list_transform(ts, lambda y: (length(lower(text)) - length(replace(lower(text), y, ''))) // length(y)))::BIGINT AS score FROM q CROSS JOIN documents), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0) SELECT query_id, count(*) AS returned, array_to_string(list(doc_id ORDER BY rn), ',') AS doc_ids, sum(length(text) // 4)::BIGINT AS tokens FROM k WHERE rn <= 3 GROUP BY 1")
def traced_search(spark: SparkSession, d: str) -> DataFrame:
    """What a search gave back and how many tokens that is; three documents a question, the limit is the feature."""
    out = C.traced_search(table(spark, d, "documents").select("doc_id", "text"), _queries(spark, d), 3)
    return out.withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ","))


# --- skills

_SK_SQL = "ev AS (SELECT 's' || user_id AS skill, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'register' WHEN event_type = 'signup' THEN 'deprecate' WHEN event_type = 'error' THEN 'check' ELSE 'use' END AS op, value > 30 AS ok FROM events)"


@query(f"WITH {_SK_SQL}, h AS (SELECT *, coalesce(last_value(CASE WHEN op = 'check' THEN ok END IGNORE NULLS) OVER (PARTITION BY skill ORDER BY seq ROWS UNBOUNDED PRECEDING), true) AS healthy FROM ev), a AS (SELECT skill, max((op = 'deprecate')::INT) AS d, arg_max(healthy, seq) AS h, count_if(op = 'use' AND healthy) AS uses FROM h GROUP BY 1) SELECT skill, CASE WHEN NOT h THEN 'dead' WHEN d = 1 THEN 'deprecated' ELSE 'active' END AS status, uses, h AS usable FROM a")
def skill_registry(spark: SparkSession, d: str) -> DataFrame:
    """Skills after their log: dead, deprecated or active, and how often they were used."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    e = table(spark, d, "events")
    op = F.when(first, "register").when(F.col("event_type") == "signup", "deprecate").when(F.col("event_type") == "error", "check").otherwise("use")
    return C.skill_registry(e.select(F.concat(F.lit("s"), "user_id").alias("skill"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("value") > 30).alias("ok")))


@query("SELECT 'skill:' || p_partkey AS doc_id, p_partkey || chr(10) || p_name || chr(10) || p_brand || ', ' || p_type AS text FROM part")
def skill_documents(spark: SparkSession, d: str) -> DataFrame:
    """Skills as documents for a search."""
    return C.skill_documents(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("skill"), F.col("p_name").alias("purpose"), F.array("p_brand", "p_type").alias("triggers")))


@query("SELECT s_suppkey, s_acctbal >= 1000 AND s_suppkey % 10 >= 3 AS meets FROM supplier")
def floor_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether every measured number reaches its floor."""
    s = table(spark, d, "supplier")
    measured = F.create_map(F.lit("balance"), F.col("s_acctbal"), F.lit("digit"), (F.col("s_suppkey") % 10).cast("double"))
    floor = F.create_map(F.lit("balance"), F.lit(1000.0), F.lit("digit"), F.lit(3.0))
    return s.select("s_suppkey", L.meets_floor(measured, floor).alias("meets"))


# --- budgets and control


@query("WITH RECURSIVE " + A.SPAN_SQL + """, an AS (SELECT trace_id, span_id, span_id AS up FROM sp UNION ALL SELECT an.trace_id, an.span_id, sp.parent_id FROM an JOIN sp ON sp.trace_id = an.trace_id AND sp.span_id = an.up WHERE sp.parent_id IS NOT NULL),
t AS (SELECT an.trace_id, up AS span_id, sum(input_tokens)::BIGINT AS spent FROM an JOIN sp ON sp.trace_id = an.trace_id AND sp.span_id = an.span_id GROUP BY ALL), o AS (SELECT t.*, 200 * (1 + trace_id % 5) - spent AS own FROM t),
a AS (SELECT an.trace_id, an.span_id, min(own)::BIGINT AS "left", count(*) - 1 AS depth FROM an JOIN o ON o.trace_id = an.trace_id AND o.span_id = an.up GROUP BY ALL) SELECT trace_id, span_id, depth, spent, "left", "left" < 0 AS over, depth > 2 AS too_deep FROM o JOIN a USING (trace_id, span_id)""")
def budget_tree(spark: SparkSession, d: str) -> DataFrame:
    """Spends counted for a span and all above it, against limits of all of them."""
    s = A.spans(spark, d)
    nodes = s.select("trace_id", "span_id", "parent_id", (F.lit(200) * (1 + F.col("trace_id") % 5)).alias("limit"))
    return C.budget_tree(nodes, s.select("trace_id", "span_id", F.col("input_tokens").alias("tokens")), most_depth=2)


@query("SELECT o_orderkey, greatest(0, least(o_custkey, 500 - o_orderkey % 700))::BIGINT AS child, least(greatest(o_custkey % 9 - 2, 1), 4)::BIGINT AS workers FROM orders")
def child_budgets(spark: SparkSession, d: str) -> DataFrame:
    """What a child may spend, and how many workers it may have."""
    return table(spark, d, "orders").select("o_orderkey", C.child_limit(F.col("o_custkey"), F.lit(500) - F.col("o_orderkey") % 700).cast("long").alias("child"), T.workers_allowed(F.col("o_custkey") % 9 - 2, F.lit(4)).cast("long").alias("workers"))


@query("WITH d AS (SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000 THEN 'price' WHEN o_orderstatus = 'P' THEN 'status' ELSE 'judge' END AS who FROM orders) SELECT count(*) AS n, count_if(who = 'judge') AS judged, round(count_if(who = 'judge') / count(*)::DOUBLE, 6) AS load FROM d")
def judge_load(spark: SparkSession, d: str) -> DataFrame:
    """How many decisions need a judge after rules that don't."""
    o = table(spark, d, "orders")
    decided = C.judge_load(o, "o_orderkey", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"}, F.col("o_custkey") % 2 == 0)
    return C.load_ratio(decided).withColumn("load", r6(F.col("load")))


_LEAK = f"(published_at IS NULL OR published_at > DATE '{AS_OF}' OR restated_at > DATE '{AS_OF}' OR period_end > DATE '{AS_OF}' OR published_at < period_end)"


@query(f"""WITH {CL_SQL}, {A.POINT_SQL}, k AS (SELECT 'look_ahead' AS rail, count_if(coalesce({_LEAK}, false)) AS hits FROM pt UNION ALL SELECT 'metric_mismatch', count_if(o_orderkey % 97 = 0 OR o_custkey % 10 = 0) FROM orders
UNION ALL SELECT 'unsupported_fact', count_if(kind IN ('measured', 'derived', 'sourced') AND n_support = 0) FROM sd UNION ALL SELECT 'unlabeled_projection', count_if(kind = 'projected' AND NOT labeled) FROM sd UNION ALL SELECT 'advisory_output', count_if(kind = 'advisory') FROM sd
UNION ALL SELECT 'misclassified_claim', count_if((said = 'advisory' AND kind <> 'advisory') OR (said = 'projected' AND kind IN ('measured', 'derived', 'sourced'))) FROM sd UNION ALL SELECT 'missing_as_of', count_if(kind IN ('measured', 'derived', 'sourced') AND coalesce(as_of, '') = '') FROM sd) SELECT rail, hits FROM k""")
def finance_rails(spark: SparkSession, d: str) -> DataFrame:
    """The seven rails over points, metrics and claims of one analysis."""
    b = F.when(F.col("o_custkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("o_custkey").cast("double"))
    inputs = F.create_map(F.lit("net_income"), F.col("o_totalprice"), F.lit("revenue"), b)
    right = F.coalesce(F.col("o_totalprice") / F.nullif(b, F.lit(0.0)), F.lit(0.0)) + F.when(F.col("o_orderkey") % 97 == 0, 1.0).otherwise(0.0)
    m = table(spark, d, "orders").select(F.lit("metric").alias("item"), F.lit("net_margin").alias("metric"), inputs.alias("inputs"), right.alias("reported"))
    p = A.data_points(spark, d).withColumn("item", F.lit("point"))
    c = _claims(spark, d).withColumn("item", F.lit("claim"))
    rows = c.unionByName(p, allowMissingColumns=True).unionByName(m, allowMissingColumns=True)
    rails = C.finance_rails(F.lit(AS_OF).cast("date"))
    return I.guardrails(rows, {k: (v, 0) for k, v in rails.items()}).select("rail", "hits")


#: Lines of assistants' turns: what has a comma cites two sources by its length, a sentence cites none, another line of an
#: odd length cites nothing, and the rest is out of form. Known sources are the regions.
_AN_SQL = """ln AS (SELECT conv_id * 100 + turn AS answer_id, unnest(string_split(text, chr(10))) AS raw FROM conversations WHERE role = 'assistant'),
cl AS (SELECT answer_id, raw, length(raw) AS n, CASE WHEN contains(raw, ',') THEN 'cited' WHEN raw LIKE '%.' THEN 'none' WHEN length(raw) % 2 = 1 THEN 'bare' ELSE 'malformed' END AS form FROM ln WHERE trim(raw) <> '')"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    def line(raw: Column) -> Column:
        n = F.char_length(raw)
        cited = F.concat(F.lit("- "), raw, F.lit(" [s"), (n % 7).cast("string"), F.lit(", s"), (n % 3).cast("string"), F.lit("]"))
        return F.when(F.contains(raw, F.lit(",")), cited).when(F.endswith(raw, F.lit(".")), F.concat(F.lit("- "), raw, F.lit(" [none]"))).when(n % 2 == 1, F.concat(F.lit("- "), raw, F.lit(" []"))).otherwise(raw)

    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("answer"))


@query(f"""WITH {_AN_SQL} SELECT answer_id, signal, sum(k)::BIGINT AS n FROM (SELECT answer_id, CASE form WHEN 'malformed' THEN 'malformed' WHEN 'bare' THEN 'no_citation' ELSE 'unknown_citation' END AS signal, 1 AS k FROM cl WHERE form IN ('malformed', 'bare') OR (form = 'cited' AND n % 7 > 4)) GROUP BY ALL""")
def answer_signals(spark: SparkSession, d: str) -> DataFrame:
    """Lines out of form, claims that cite nothing, and citations of sources that aren't known, in turns of assistants."""
    lines = I.claim_lines(_answers(spark, d))
    known = table(spark, d, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("source_id"))
    return C.answer_signal(lines.where("malformed IS NULL"), lines.where("malformed IS NOT NULL"), known)


@query(f"WITH {_AN_SQL} SELECT answer_id, count_if(form <> 'malformed') AS n_claims, count_if(form <> 'malformed') = 1 AND bool_or(form = 'none') AS abstains FROM cl GROUP BY 1")
def abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose only claim says that nothing is known."""
    lines = I.claim_lines(_answers(spark, d)).groupBy("answer_id").agg(F.count("ids").alias("n_claims"), F.flatten(F.collect_list("ids")).alias("ids"))
    return lines.select("answer_id", "n_claims", C.abstains(F.col("ids"), F.col("n_claims")).alias("abstains"))


@query("WITH r AS (SELECT l_orderkey AS item, l_linestatus = 'F' OR l_tax < 0.04 AS passed, 'line ' || l_linenumber AS locus FROM lineitem) SELECT item, bool_and(passed) AS passed, coalesce(array_to_string(list_sort(list(DISTINCT locus) FILTER (WHERE NOT passed)), ','), '') AS loci FROM r GROUP BY 1")
def failure_loci(spark: SparkSession, d: str) -> DataFrame:
    """Where verifiers found faults."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), ((F.col("l_linestatus") == "F") | (F.col("l_tax") < 0.04)).alias("passed"), F.concat(F.lit("line "), "l_linenumber").alias("locus"))
    return C.failure_loci(r).withColumn("loci", F.array_join("loci", ","))


_USE_SQL = f"{A.SPAN_SQL}, us AS (SELECT seq, CASE WHEN kind = 'selection' THEN 'refine' ELSE 'chain' END AS pattern, CASE WHEN length(text) % 5 <> 0 THEN left(text, 9) ELSE ' ' END AS justification, kind = 'selection' AND span_id % 3 = 0 AS external FROM sp)"


def _uses(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d)
    selection = F.col("kind") == "selection"
    return s.select("seq", F.when(selection, "refine").otherwise("chain").alias("pattern"), F.when(F.char_length("text") % 5 != 0, F.left("text", F.lit(9))).otherwise(" ").alias("justification"), (selection & (F.col("span_id") % 3 == 0)).alias("external"))


@query(f"WITH {_USE_SQL} SELECT seq, CASE WHEN trim(justification, chr(32)) = '' THEN 'no_justification' WHEN pattern = 'refine' AND NOT external THEN 'no_outside_signal' END AS fault FROM us")
def justified_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Uses of a pattern that give no reason, or go by an opinion."""
    return C.justified(_uses(spark, d)).select("seq", "fault")


@query(f"WITH {_USE_SQL} SELECT pattern, count(*) AS n, arg_max(justification, seq) AS justification FROM us GROUP BY 1")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each control pattern and its last reason."""
    u = _uses(spark, d).withColumn("attributes", F.create_map(F.lit("pattern"), F.col("pattern"), F.lit("justification"), F.col("justification")))
    return T.pattern_counts(u)


@query("WITH a AS (SELECT * FROM orders WHERE o_orderstatus <> 'P') SELECT 'half' AS worker, count(*) AS n, round(sum(o_totalprice / 2), 2) AS total FROM a UNION ALL SELECT 'double', count(*), round(sum(o_totalprice * 2), 2) FROM a")
def chained_workers(spark: SparkSession, d: str) -> DataFrame:
    """Two workers over the same chain of steps."""
    rows = C.chain(table(spark, d, "orders"), [lambda x: x.where("o_orderstatus <> 'P'"), lambda x: x.select("o_orderkey", "o_totalprice")])
    out = C.parallel(rows, {"half": lambda x: x.withColumn("v", F.col("o_totalprice") / 2), "double": lambda x: x.withColumn("v", F.col("o_totalprice") * 2)})
    return out.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'half' WHEN 'O' THEN 'double' END AS worker, count(*) AS n, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice / 2 WHEN 'O' THEN o_totalprice * 2 END), 2) AS total FROM orders GROUP BY 1")
def orchestrated_workers(spark: SparkSession, d: str) -> DataFrame:
    """Each row to the worker its plan names; rows whose plan names none come back."""
    plan = F.when(F.col("o_orderstatus") == "F", "half").when(F.col("o_orderstatus") == "O", "double").otherwise("nobody")
    out = C.orchestrate(table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), plan, {"half": lambda x: x.withColumn("v", F.col("o_totalprice") / 2), "double": lambda x: x.withColumn("v", F.col("o_totalprice") * 2)})
    return out.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


#: Splitting after sentence marks and at line feeds, for SQL without lookbehind.
SENTENCE_SQL = "string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(30), 'g'), chr(30) || '|\\n+')"


@query(f"WITH s AS (SELECT doc_id, {SENTENCE_SQL} AS p FROM documents), x AS (SELECT DISTINCT doc_id, trim(unnest(p)) AS t FROM s) SELECT doc_id, count(*) AS n, max(length(t)) AS longest FROM x WHERE regexp_matches(t, '[|#]') AND t <> '' GROUP BY 1")
def marked_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How many different sentences of a document bear a mark, and the longest."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.source_sentences(t, [r"[|#]"]).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("sentence")).alias("longest"))


@query("WITH s AS (SELECT doc_id, text, string_split_regex(text, '\\n+') AS p FROM documents), x AS (SELECT doc_id, trim(unnest(p), ' ' || chr(9) || chr(13)) AS t FROM s) SELECT doc_id, count(DISTINCT t) AS n FROM x WHERE regexp_matches(t, '[|#]') AND t <> '' GROUP BY 1")
def marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many different lines of a document bear a mark; sentence ends are taken out first, so that lines are sentences."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"(?<=[.!?])[ \t\r\f\x0b]+", "~").alias("text"))
    return C.source_sentences(t, [r"[|#]"]).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GOLD_SQL} SELECT question_id, len(missed)::INT AS n_missed FROM sg ORDER BY len(missed) DESC, question_id LIMIT 5")
def worst_missed(spark: SparkSession, d: str) -> DataFrame:
    """The five questions that miss the most: the limit is the feature."""
    return _gold(spark, d).select("question_id", F.size("missed").alias("n_missed")).orderBy(F.desc("n_missed"), "question_id").limit(5)


# --- operators without a query of their own


@query(f"{SP} SELECT round(avg((status = 'ok')::INT), 6) AS success_rate, round(avg(input_tokens), 6) AS tokens_per_task, round(avg(ended_at - started_at), 6) AS seconds_per_task, round(avg((status = 'ok')::INT) / (avg(input_tokens) / 1000), 6) AS success_per_1k FROM sp")
def suite_report(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d).select((F.col("status") == "ok").alias("success"), F.col("input_tokens").alias("tokens"), (F.col("ended_at") - F.col("started_at")).alias("seconds"))
    out = T.suite_report(s)
    return out.withColumns({c: r6(F.col(c)) for c in out.columns})


@query(f"{SP} SELECT component, count(*) AS calls, count(DISTINCT name) - 1 AS variety, count(*) >= 100 AND count(DISTINCT name) - 1 >= 2 AS eligible FROM sp WHERE component IS NOT NULL GROUP BY 1")
def distill_entry(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d).where(F.col("component").isNotNull()).select("component", F.col("name").alias("signature"))
    return T.distill_entry(s, least_variety=2)


@query("SELECT task_key, CASE m WHEN 'deterministic' THEN 'd' || task_key % 3 WHEN 'replay' THEN 'r' || task_key % 4 ELSE 'p' || top END AS chosen, m AS mode FROM (SELECT s_suppkey AS task_key, arg_max(l_linenumber, {'v': l_quantity, 's': -(l_orderkey * 10 + l_linenumber)}) AS top FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), (SELECT unnest(['deterministic', 'replay', 'dynamic']) AS m)")
def task_choices(spark: SparkSession, d: str) -> DataFrame:
    """A choice for each task by default, by record, and by value."""
    l = table(spark, d, "lineitem")  # noqa: E741
    tasks = l.select(F.col("l_suppkey").alias("task_key")).distinct().withColumn("default", F.concat(F.lit("d"), F.col("task_key") % 3))
    past = tasks.select("task_key", F.concat(F.lit("r"), F.col("task_key") % 4).alias("chosen"))
    best = l.select(F.col("l_suppkey").alias("task_key"), F.concat(F.lit("p"), "l_linenumber").alias("ref"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    out = [L.choose(tasks, m, history=past, ranked=best).withColumn("mode", F.lit(m)) for m in ("deterministic", "replay", "dynamic")]
    return out[0].union(out[1]).union(out[2])


@query("WITH c AS (SELECT user_id AS reviewer, event_type AS target, sum(greatest(value, 0)) AS c FROM events GROUP BY ALL) SELECT target, round(sum(sqrt(c * 4)), 5) AS score, 3 AS rounds, false AS converged FROM c GROUP BY 1")
def deliberation(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of votes, credits doubled in each, without a majority."""
    rv = table(spark, d, "events").select(F.col("user_id").cast("string").alias("reviewer"), F.col("event_type").alias("target"), F.col("value").alias("credits"))
    scores, rounds, converged = L.deliberate(rv, lambda r, s, n: r.withColumn("credits", F.col("credits") * 2), rounds=3, enough=0.6)
    return scores.select("target", F.round("score", 5).alias("score"), F.lit(rounds).alias("rounds"), F.lit(converged).alias("converged"))


@query("SELECT o_orderkey, greatest(o_custkey % 5, 2)::BIGINT AS v, least(greatest(2 - o_custkey % 5, 0), 3)::INT AS round FROM orders")
def refined_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows repaired until an outside check passes."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("v"))
    return L.refine(o, lambda r: r.where("v < 2"), lambda r, n: r.withColumn("v", F.col("v") + 1), "o_orderkey").select("o_orderkey", "v", "round")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, 'a' || l_suppkey AS answer FROM lineitem")
def replayed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers by key; a missing one would be an error."""
    req = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").cast("string").alias("key"))
    tape = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.concat(F.lit("a"), "s_suppkey").alias("answer"))
    return T.replay(req, tape).select("id", "answer")


@query(f"WITH s AS (SELECT conv_id * 100 + turn AS id, {SENTENCE_SQL} AS p FROM conversations) SELECT id, count(*) AS n, max(length(t)) AS longest FROM (SELECT id, unnest(p) AS t FROM s) WHERE trim(t) <> '' GROUP BY 1")
def turn_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each turn, and the longest."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return L.sentences(c).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("sentence")).alias("longest"))


@query("SELECT 'late' AS rail, count_if(l_tax > 0.07) AS hits, count_if(l_tax > 0.07) > 0 AND count_if(l_tax > 0.07) <= 1000000 AS tolerated FROM lineitem UNION ALL SELECT 'huge', count_if(l_quantity > 49.5), false FROM lineitem")
def reasoned_rails(spark: SparkSession, d: str) -> DataFrame:
    """Rails that tolerate hits say why."""
    rails = I.reasoned({"late": (F.col("l_tax") > 0.07, 1_000_000), "huge": (F.col("l_quantity") > 49.5, 0)}, {"late": "old rates are being replaced"})
    return I.guardrails(table(spark, d, "lineitem"), rails).select("rail", "hits", "tolerated")
