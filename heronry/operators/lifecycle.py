"""Registries, skills, verification stacks, deliberation, replay modes, and matching of names to series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import ratio
from heronry.operators.integrity import entails, quadratic_votes

# --- registries and skills


def resolve(requests: DataFrame, versions: DataFrame, fallback: str) -> DataFrame:
    """Requests (request_id, component) with the last live version by text, or the fallback component's."""
    last = versions.where(~F.coalesce("deprecated", F.lit(False))).groupBy("component").agg(F.max("version").alias("version"))
    other = last.where(F.col("component") == fallback).select(F.col("version").alias("_v"))
    out = requests.join(last, "component", "left").join(F.broadcast(other.agg(F.max("_v").alias("_v"))))
    return out.select("request_id", F.when(F.col("version").isNull(), F.lit(fallback)).otherwise(F.col("component")).alias("component"), F.coalesce("version", "_v").alias("version"), F.col("version").isNull().alias("fell_back"))


def skill_search(skills: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, skill, score, rn): usable skills by how many different query words their text holds; none with 0.

    Words hold no blanks, so a word stands in a text if it is a part of one of the text's words: the parts of all words,
    of the lengths that are asked for, meet the words asked for in an equi-join.
    """
    split = lambda text: F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")))
    asked = queries.select("query_id", split(F.col("query")).alias("part"))
    held = skills.where(F.col("status").isin("active", "deprecated")).select("skill", split(F.col("text")).alias("word"))
    lengths = asked.select(F.length("part").alias("n")).distinct()  # as many as words have lengths
    parts = held.select("word").distinct().join(F.broadcast(lengths), F.col("n") <= F.length("word")).select("word", F.explode(F.expr("transform(sequence(1, length(word) - n + 1), p -> substring(word, p, n))")).alias("part")).distinct()
    met = asked.join(parts, "part").join(held, "word").select("query_id", "skill", "part").distinct()
    scored = met.groupBy("query_id", "skill").agg(F.count(F.lit(1)).cast("int").alias("score"))
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "skill")).cast("long")).where(F.col("rn") <= k)


def health_sweep(skills: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """(status, n, skills): the skills of each status, empty statuses too."""
    grid = skills.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    got = skills.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("skill")).alias("skills"))
    return grid.join(got, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def meets_floor(measured: Column, floor: Column) -> Column:
    """Whether every metric of the floor is reached; one that wasn't measured isn't."""
    return F.forall(F.map_entries(floor), lambda e: F.coalesce(F.try_element_at(measured, e["key"]) >= e["value"], F.lit(False)))


def suite_coverage(cases: DataFrame, levels: int = 7) -> DataFrame:
    """One row: cases, share of failing ones, share of levels that have cases."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), ratio(F.count_if(~F.col("passed")), F.count(F.lit(1))).alias("failure_ratio"), (F.countDistinct("level") / F.lit(float(levels))).alias("level_coverage"))


def golden_paths(spans: DataFrame, golden: DataFrame) -> DataFrame:
    """(case_id, matches): whether a trace's span names in order are the golden ones."""
    path = spans.groupBy(F.col("trace_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda s: s["name"]).alias("path"))
    return golden.join(path, "case_id", "left").select("case_id", F.coalesce(F.col("path") == F.col("golden"), F.lit(False)).alias("matches"))


# --- verification


def grounding(claims: DataFrame, sources: DataFrame, *, least: float = 0.6) -> DataFrame:
    """(id, verdict): unsupported if no cited source is known, not_entailed if none holds enough of its words, else ok.

    ``claims``: (id, text, ids); ``sources``: (source_id, text).
    """
    cited = claims.select("id", "text", F.explode_outer("ids").alias("source_id")).join(sources.select("source_id", F.col("text").alias("support")), "source_id", "left")
    out = cited.groupBy("id").agg(F.max(F.col("support").isNotNull()).alias("known"), F.max(F.coalesce(entails(F.col("text"), F.col("support"), least), F.lit(False))).alias("entailed"))
    return out.select("id", F.when(~F.col("known"), "unsupported").when(~F.col("entailed"), "not_entailed").otherwise("ok").alias("verdict"))


def tiered(rows: DataFrame, key: str, cheap: Mapping[str, Column], costly: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, verdict): rows that fail a cheap rule are settled; only the rest go to ``costly``, which gives (key, verdict).

    The split is two filters on two branches: Spark doesn't promise an order of conditions within one.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cheap.items()]))
    marked = rows.withColumn("_failed", failed)
    settled = marked.where(F.size("_failed") > 0).select(key, F.get("_failed", 0).alias("verdict"))
    return settled.union(costly(marked.where(F.size("_failed") == 0).drop("_failed")).select(key, "verdict"))


def deliberate(first: DataFrame, revise: Callable[[DataFrame, DataFrame, int], DataFrame], *, rounds: int = 3, enough: float = 0.6) -> tuple[DataFrame, int, bool]:
    """(scores, rounds used, converged): votes until the top target's share of all scores is enough, or rounds are up.

    ``revise`` makes the next reviews from the last ones and the scores. A round is one grouped job and one row comes back.
    """
    reviews = first
    for n in range(1, rounds + 1):
        scores = quadratic_votes(reviews)
        top, total = scores.agg(F.max("score"), F.sum("score")).first()
        if total and top / total >= enough:
            return scores, n, True
        if n < rounds:
            reviews = revise(reviews, scores, n)
    return scores, rounds, False


def refine(rows: DataFrame, fails: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame, int], DataFrame], key: str, *, rounds: int = 3) -> DataFrame:
    """Rows after at most ``rounds`` repairs; only those that an outside check fails are fed back."""
    done = None
    for n in range(rounds):
        bad = fails(rows).select(key).distinct()
        good = rows.join(bad, key, "left_anti").withColumn("round", F.lit(n))
        done = good if done is None else done.unionByName(good)
        rows = repair(rows.join(bad, key, "left_semi"), n + 1)
        if rows.isEmpty():
            return done
    return done.unionByName(rows.withColumn("round", F.lit(rounds)))


def choose(tasks: DataFrame, mode: str, *, history: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """(task_key, chosen): the fixed default, the recorded choice, or the best ranked one. A replay without a record, and a dynamic choice without any value, are errors."""
    if mode == "deterministic":
        return tasks.select("task_key", F.col("default").alias("chosen"))
    if mode == "replay":
        j = tasks.select("task_key").join(history, "task_key", "left")
        return j.select("task_key", F.coalesce("chosen", F.raise_error(F.format_string("no recorded choice for %s", F.col("task_key")))).alias("chosen"))
    if mode == "dynamic":
        best = ranked.where(F.col("value").isNotNull()).groupBy("task_key").agg(F.max_by("ref", F.struct("value", -F.col("seq"))).alias("chosen"))
        j = tasks.select("task_key").join(best, "task_key", "left")
        return j.select("task_key", F.coalesce("chosen", F.raise_error(F.format_string("cold start: no value known for %s", F.col("task_key")))).alias("chosen"))
    raise ValueError(f"unknown mode {mode!r}")


# --- names


def name_key(name: Column, prefixes: Sequence[str] = ("distorted", "noise")) -> Column:
    """Lower case without underscores and blanks, known prefixes taken off in turn."""
    out = F.regexp_replace(F.lower(name), r"[_\s]+", "")
    for p in prefixes:
        out = F.regexp_replace(out, f"^{p}", "")
    return out


def match_names(mentions: DataFrame, series: DataFrame) -> DataFrame:
    """(mention, num, how): the series a mention means: by equal key, by key of a cross reference, or as a part of its key.

    ``mentions``: (mention, is_reference); ``series``: (num, name). Ways are tried in that order, the smallest number
    wins. Parts are looked up by the mentions' own substrings of the lengths that series keys have, an equi-join.
    """
    s = series.select("num", name_key(F.col("name")).alias("key")).where("length(key) > 2")
    m = mentions.select("mention", "is_reference", name_key(F.col("mention")).alias("mk"))
    equal = m.join(s, F.col("mk") == F.col("key")).select("mention", "num", F.when(F.col("is_reference"), 2).otherwise(1).alias("p"))
    lengths = s.select(F.length("key").alias("n")).distinct()
    parts = m.join(F.broadcast(lengths), F.col("n") <= F.length("mk")).select("mention", "mk", "n", F.explode(F.expr("sequence(1, length(mk) - n + 1)")).alias("at")).select("mention", F.expr("substring(mk, at, n)").alias("key")).distinct()
    part = parts.join(s, "key").select("mention", "num", F.lit(3).alias("p"))
    best = equal.union(part).groupBy("mention").agg(F.min(F.struct("p", "num")).alias("b"))
    return best.select("mention", "b.num", F.element_at(F.array(F.lit("key"), F.lit("reference"), F.lit("part")), F.col("b.p")).alias("how"))


def first_rule(texts: DataFrame, rules: Sequence[tuple[str, str]], key: str = "id") -> DataFrame:
    """(id, label, line): label of the first line that a rule matches, rules tried in order on each line; NULL if none."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line", "t"))
    label = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        label = F.when(F.col("t").rlike(pattern), F.lit(name)).otherwise(label)
    hit = lines.withColumn("label", label).where("label IS NOT NULL").groupBy(key).agg(F.min(F.struct("line", "label")).alias("h"))
    return texts.select(key).join(hit, key, "left").select(key, F.col("h.label").alias("label"), F.col("h.line").alias("line"))


def sentences(texts: DataFrame, key: str = "id") -> DataFrame:
    """(id, pos, sentence): split after sentence marks and at line feeds, empty ones left out."""
    return texts.select(key, F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("pos", "sentence")).where(F.trim("sentence") != "")


def condition_grid(spark, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the values of a few parameters, as text."""
    from itertools import product

    rows = [tuple(str(v) for v in c) for c in product(*axes.values())]
    return spark.createDataFrame(rows, ", ".join(f"{a} string" for a in axes))
