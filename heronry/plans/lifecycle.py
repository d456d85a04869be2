"""Queries: registries, verification, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.numeric import r6
from heronry.operators import lifecycle as L
from heronry.plans import adapters as A
from heronry.plans.registry import query, table


@query("WITH v AS (SELECT p_brand AS c, max(p_type) AS version FROM part WHERE p_size % 5 <> 0 AND p_brand <> 'Brand#11' GROUP BY 1), r AS (SELECT p_partkey AS request_id, p_brand AS c FROM part), f AS (SELECT version AS fv FROM v WHERE c = 'Brand#12') SELECT request_id, CASE WHEN version IS NULL THEN 'Brand#12' ELSE c END AS component, coalesce(version, fv) AS version, version IS NULL AS fell_back FROM r LEFT JOIN v USING (c), f")
def registry_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = p.select(F.col("p_brand").alias("component"), F.col("p_type").alias("version"), ((F.col("p_size") % 5 == 0) | (F.col("p_brand") == "Brand#11")).alias("deprecated"))
    return L.resolve(p.select(F.col("p_partkey").alias("request_id"), F.col("p_brand").alias("component")), v, "Brand#12")


@query("WITH s AS (SELECT p_partkey::VARCHAR AS skill, lower(p_name || ' ' || p_type) AS t FROM part WHERE p_size % 3 <> 0), q AS (SELECT n_nationkey AS query_id, list_distinct(string_split(lower(p_type || ' ' || n_name), ' ')) AS ws FROM nation JOIN part ON p_partkey = n_nationkey + 1), h AS (SELECT query_id, skill, len(list_filter(ws, lambda w: contains(t, w)))::INT AS score FROM q, s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill) AS rn FROM h WHERE score > 0) SELECT query_id, skill, score, rn FROM r WHERE rn <= 3")
def skill_search(spark: SparkSession, d: str) -> DataFrame:
    """Three skills a question: the limit is the feature."""
    p = table(spark, d, "part")
    s = p.select(F.col("p_partkey").cast("string").alias("skill"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.when(F.col("p_size") % 3 != 0, "active").otherwise("dead").alias("status"))
    q = table(spark, d, "nation").join(p, F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", "p_type", "n_name").alias("query"))
    return L.skill_search(s, q)


@query("WITH g AS (SELECT unnest(['F', 'O', 'P', 'X']) AS status), c AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) SELECT status, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (status)")
def health_sweep(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("skill"), F.col("o_orderstatus").alias("status"))
    return L.health_sweep(o, ["F", "O", "P", "X"]).select("status", "n")


@query("SELECT count(*) AS cases, round(count(*) FILTER (WHERE o_orderstatus <> 'F') / count(*)::DOUBLE, 6) AS failure_ratio, round(count(DISTINCT o_orderpriority) / 7.0::DOUBLE, 6) AS level_coverage FROM orders")
def suite_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("passed"), F.col("o_orderpriority").alias("level"))
    return L.suite_coverage(c).withColumns({k: r6(F.col(k)) for k in ("failure_ratio", "level_coverage")})


@query(f"WITH {A.SPAN_SQL}, p AS (SELECT trace_id, list(name ORDER BY seq) AS path FROM sp GROUP BY 1) SELECT trace_id AS case_id, path = ['user', 'assistant'] AS matches FROM p")
def golden_paths(spark: SparkSession, d: str) -> DataFrame:
    s = A.spans(spark, d)
    return L.golden_paths(s, s.select(F.col("trace_id").alias("case_id")).distinct().withColumn("golden", F.array(F.lit("user"), F.lit("assistant"))))


_WS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[0-9a-z가-힣]+')), lambda y: length(y) > 1)"


@query(f"WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text FROM conversations WHERE turn > 0), k AS (SELECT c.id, b.text IS NOT NULL AS known, coalesce(len(list_intersect({_WS.format(x='c.text')}, {_WS.format(x='b.text')})) / nullif(len({_WS.format(x='c.text')}), 0)::DOUBLE >= 0.2, false) AS ent FROM c LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 AND b.turn % 3 <> 1) SELECT id, CASE WHEN NOT known THEN 'unsupported' WHEN NOT ent THEN 'not_entailed' ELSE 'ok' END AS verdict FROM k")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    """Turns that cite the one before; every third cites one that there isn't."""
    c = table(spark, d, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    claims = c.where("turn > 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.array(F.concat_ws(":", "conv_id", F.when(F.col("turn") % 3 == 2, -1).otherwise(F.col("turn") - 1))).alias("ids"))
    return L.grounding(claims, c.select(key.alias("source_id"), "text"), least=0.2)


@query("WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice <= 1000 THEN 'price' WHEN o_orderstatus = 'P' THEN 'status' END AS cheap, o_custkey % 2 = 0 AS odd FROM orders) SELECT id, coalesce(cheap, CASE WHEN odd THEN 'judge' ELSE 'ok' END) AS verdict FROM s")
def tiered_verification(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    judge = lambda rows: rows.withColumn("verdict", F.when(F.col("o_custkey") % 2 == 0, "judge").otherwise("ok"))
    return L.tiered(o, "id", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"}, judge)


_NK = "regexp_replace(regexp_replace(regexp_replace(lower({x}), '[_\\s]+', '', 'g'), '^distorted', ''), '^noise', '')"


@query(f"WITH s AS (SELECT n_nationkey AS num, {_NK.format(x='n_name')} AS key FROM nation), m AS (SELECT c_custkey AS mention_id, CASE c_custkey % 3 WHEN 0 THEN 'DISTORTED' || n_name WHEN 1 THEN 'file of ' || n_name || ' x' ELSE n_name END AS mention, c_custkey % 3 = 0 AS is_reference FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT DISTINCT mention, is_reference FROM m), k AS (SELECT *, {_NK.format(x='mention')} AS mk FROM u), h AS (SELECT mention, num, CASE WHEN is_reference THEN 2 ELSE 1 END AS p FROM k JOIN s ON mk = key UNION ALL SELECT mention, num, 3 FROM k JOIN s ON contains(mk, key)), b AS (SELECT mention, arg_min({{'n': num, 'p': p}}, p * 1000 + num) AS b FROM h GROUP BY 1) SELECT mention, b.n AS num, CASE b.p WHEN 1 THEN 'key' WHEN 2 THEN 'reference' ELSE 'part' END AS how FROM b")
def match_names(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of nations, with prefixes and inside other words."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    m = c.select(F.when(k % 3 == 0, F.concat(F.lit("DISTORTED"), "n_name")).when(k % 3 == 1, F.concat(F.lit("file of "), "n_name", F.lit(" x"))).otherwise(F.col("n_name")).alias("mention"), (k % 3 == 0).alias("is_reference")).distinct()
    return L.match_names(m, n.select(F.col("n_nationkey").alias("num"), F.col("n_name").alias("name")))


@query("WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM ls), h AS (SELECT doc_id, line, CASE WHEN regexp_matches(t, '[0-9]{6}') THEN 'digits' WHEN regexp_matches(t, '[A-Z]{8}') THEN 'capitals' WHEN regexp_matches(t, '[|#]') THEN 'marks' END AS label FROM x), b AS (SELECT doc_id, arg_min({'l': label, 'n': line}, line) AS b FROM h WHERE label IS NOT NULL GROUP BY 1) SELECT documents.doc_id AS id, b.l AS label, b.n::INT AS line FROM documents LEFT JOIN b USING (doc_id)")
def first_rule(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.first_rule(t, [("digits", "[0-9]{6}"), ("capitals", "[A-Z]{8}"), ("marks", "[|#]")])
