"""Corpora, skills, budgets, verification signals and control patterns over span and document tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import close, ratio
from heronry.operators.integrity import VERIFIABLE, claim_kind, keyword_topk, leak, metrics, word_set
from heronry.operators.trace import ancestors


# --- documents


def corpus_state(log: DataFrame) -> DataFrame:
    """(doc_id, text): documents after a log (seq, op, doc_id, text) of add, remove and forget; forget drops all before it."""
    wiped = log.where("op = 'forget'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_w"))
    last = log.where("op <> 'forget'").groupBy("doc_id").agg(F.max_by(F.struct("seq", "op", "text"), "seq").alias("v"))
    return last.crossJoin(F.broadcast(wiped)).where((F.col("v.op") == "add") & (F.col("v.seq") > F.col("_w"))).select("doc_id", "v.text")  # one row of a number


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n_docs): words of a corpus, and in how many documents each is."""
    return docs.select("doc_id", F.explode(word_set(F.col("text"))).alias("word")).groupBy("word").agg(F.countDistinct("doc_id").alias("n_docs"))


def degraded(answers: DataFrame) -> DataFrame:
    """Answers with ``degraded``: verifiable, and blocked, not grounded, or with missing parts."""
    bad = F.coalesce("blocked", F.lit(False)) | ~F.coalesce("grounded", F.lit(False)) | (F.coalesce(F.size("missing"), F.lit(0)) > 0)
    return answers.withColumn("degraded", F.coalesce("verifiable", F.lit(False)) & bad)


def breach_index(breaches: DataFrame, claims: DataFrame) -> DataFrame:
    """(answer_id, rule, claims): which claims, by position, break each rule of an answer."""
    j = breaches.join(claims.select("answer_id", "claim_id", "pos"), ["answer_id", "claim_id"])
    return j.groupBy("answer_id", "rule").agg(F.array_sort(F.collect_set("pos")).alias("claims"))


def traced_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, returned, doc_ids, tokens): what a search gave back, by rank, and about how many tokens that is (a quarter of the characters)."""
    top = keyword_topk(docs, queries, k).join(docs.select("doc_id", F.floor(F.char_length("text") / 4).alias("t")), "doc_id")
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"), F.sum("t").alias("tokens"))


# --- skills


def skill_registry(events: DataFrame) -> DataFrame:
    """(skill, status, uses, usable) from a log (seq, op, skill, ok) of register, deprecate, check and use.

    A skill registered twice is an error when it is read. The last check decides: a failed one makes a skill dead;
    a deprecated one stays usable; uses count while the skill isn't dead at the time.
    """
    w = Window.partitionBy("skill").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    healthy = F.coalesce(F.last(F.when(F.col("op") == "check", F.col("ok")), ignorenulls=True).over(w), F.lit(True))
    e = events.withColumn("_healthy", healthy)
    out = e.groupBy("skill").agg(F.count_if(F.col("op") == "register").alias("_r"), F.max((F.col("op") == "deprecate").cast("int")).alias("_d"), F.max_by("_healthy", "seq").alias("_h"), F.count_if((F.col("op") == "use") & F.col("_healthy")).alias("uses"))
    once = F.when(F.col("_r") <= 1, F.lit(True)).otherwise(F.raise_error(F.format_string("%s is registered twice", F.col("skill"))).cast("boolean"))
    status = F.when(~F.col("_h"), "dead").when(F.col("_d") == 1, "deprecated").otherwise("active")
    return out.where(once & (F.col("_r") > 0)).select("skill", status.alias("status"), "uses", (status != "dead").alias("usable"))


def skill_documents(skills: DataFrame) -> DataFrame:
    """(doc_id, text): skills as documents for a search: name, what it is for, and its triggers."""
    return skills.select(F.concat(F.lit("skill:"), "skill").alias("doc_id"), F.concat_ws("\n", "skill", "purpose", F.array_join("triggers", ", ")).alias("text"))


# --- budgets


def budget_tree(nodes: DataFrame, spends: DataFrame, *, most_depth: int = 8) -> DataFrame:
    """(trace_id, span_id, depth, spent, left, over, too_deep): every spend counts for its node and all above it.

    ``nodes``: (trace_id, span_id, parent_id, limit); ``spends``: (trace_id, span_id, tokens). A node has what its own limit
    and those above it leave, whichever is least.
    """
    up = ancestors(nodes.select("trace_id", "span_id", "parent_id"))
    total = up.join(spends.groupBy("trace_id", "span_id").agg(F.sum("tokens").alias("tokens")), ["trace_id", "span_id"]).groupBy("trace_id", F.col("ancestor").alias("span_id")).agg(F.sum("tokens").alias("spent"))
    own = nodes.join(total, ["trace_id", "span_id"], "left").select("trace_id", "span_id", F.coalesce("spent", F.lit(0)).alias("spent"), (F.col("limit") - F.coalesce("spent", F.lit(0))).alias("own_left"))
    above = up.join(own.select("trace_id", F.col("span_id").alias("ancestor"), "own_left"), ["trace_id", "ancestor"]).groupBy("trace_id", "span_id").agg(F.min("own_left").alias("left"), (F.count(F.lit(1)) - 1).alias("depth"))
    return own.join(above, ["trace_id", "span_id"]).select("trace_id", "span_id", "depth", "spent", "left", (F.col("left") < 0).alias("over"), (F.col("depth") > most_depth).alias("too_deep"))


def child_limit(wanted: Column, left: Column) -> Column:
    """What a child may spend: what it wants, but no more than what is left, and never less than 0."""
    return F.greatest(F.lit(0), F.least(F.coalesce(wanted, left), left))


# --- verification


def judge_load(rows: DataFrame, key: str, rules: Mapping[str, Column], judged: Column) -> DataFrame:
    """(key, by, passed): rules that need no judge decide first; the judge's verdict counts only where none of them fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.withColumn("_f", failed).select(key, F.when(F.size("_f") > 0, F.get("_f", 0)).otherwise("judge").alias("by"), ((F.size("_f") == 0) & F.coalesce(judged, F.lit(False))).alias("passed"))


def load_ratio(decided: DataFrame) -> DataFrame:
    """One row: decisions, those that took a judge, and their share."""
    return decided.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by") == "judge").alias("judged"), ratio(F.count_if(F.col("by") == "judge"), F.count(F.lit(1))).alias("load"))


def finance_rails(as_of: Column, *, tolerance: float = 1e-6) -> dict[str, Column]:
    """The seven conditions that an item of an analysis breaks, by name.

    Items have ``item``: point, metric or claim; a condition is false for items of other sorts.
    """
    claim, verifiable = F.col("item") == "claim", F.col("kind").isin(*VERIFIABLE)
    value = F.lit(None).cast("double")
    for name, m in metrics().items():
        value = F.when(F.col("metric") == name, m).otherwise(value)
    said = claim_kind(F.col("text"))
    disagrees = ((said == "advisory") & (F.col("kind") != "advisory")) | ((said == "projected") & verifiable)
    rails = {
        "look_ahead": (F.col("item") == "point") & leak(as_of).isNotNull(),
        "metric_mismatch": (F.col("item") == "metric") & ~F.coalesce(close(value, F.col("reported"), tolerance), F.lit(False)),
        "unsupported_fact": claim & verifiable & (F.coalesce(F.size("support"), F.lit(0)) <= 0),
        "unlabeled_projection": claim & (F.col("kind") == "projected") & ~F.coalesce("labeled", F.lit(False)),
        "advisory_output": claim & (F.col("kind") == "advisory"),
        "misclassified_claim": claim & disagrees,
        "missing_as_of": claim & verifiable & (F.coalesce("as_of", F.lit("")) == ""),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rails.items()}


def answer_signal(claims: DataFrame, malformed: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, signal, n): lines out of form, claims without a citation, and citations of unknown sources."""
    cited = claims.select("answer_id", "claim_id", F.explode("ids").alias("source_id")).where("source_id <> 'none'")
    unknown = cited.join(known.select("source_id"), "source_id", "left_anti").select("answer_id", F.lit("unknown_citation").alias("signal"))
    bare = claims.where(F.size("ids") == 0).select("answer_id", F.lit("no_citation").alias("signal"))
    return malformed.select("answer_id", F.lit("malformed").alias("signal")).union(bare).union(unknown).groupBy("answer_id", "signal").agg(F.count(F.lit(1)).alias("n"))


def abstains(ids: Column, n_claims: Column) -> Column:
    """Whether an answer says it doesn't know: one claim that cites nothing but "none"."""
    return (n_claims == 1) & (ids == F.array(F.lit("none")))


def failure_loci(results: DataFrame) -> DataFrame:
    """(item, passed, loci): whether all verifiers pass, and where those that don't found it, in order, each place once."""
    out = results.groupBy("item").agg(F.min("passed").alias("passed"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("locus")))).alias("loci"))
    return out.select("item", F.coalesce("passed", F.lit(False)).alias("passed"), "loci")


# --- control


def justified(uses: DataFrame) -> DataFrame:
    """Uses with ``fault``: a pattern without a justification, or one that goes by an opinion instead of an outside signal."""
    fault = F.when(F.trim(F.coalesce("justification", F.lit(""))) == "", "no_justification").when((F.col("pattern") == "refine") & ~F.coalesce("external", F.lit(False)), "no_outside_signal")
    return uses.withColumn("fault", fault)


def chain(rows: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """One step's rows are the next one's: a single plan."""
    for step in steps:
        rows = step(rows)
    return rows


def parallel(rows: DataFrame, workers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each worker's rows from the same input, with ``worker``."""
    out = None
    for name, run in workers.items():
        part = run(rows).withColumn("worker", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def orchestrate(rows: DataFrame, plan: Column, workers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row goes to the worker that ``plan`` names; rows without a known one come back with worker NULL."""
    planned = rows.withColumn("_plan", plan)
    parts = [run(planned.where(F.col("_plan") == name).drop("_plan")).withColumn("worker", F.lit(name)) for name, run in workers.items()]
    out = planned.where(F.col("_plan").isNull() | ~F.col("_plan").isin(*workers)).drop("_plan").withColumn("worker", F.lit(None).cast("string"))
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def source_sentences(texts: DataFrame, patterns: Sequence[str], key: str = "id") -> DataFrame:
    """(id, pos, sentence): sentences that match any pattern, each once, in the order of their first place."""
    sent = texts.select(key, F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("sentence").rlike(p)
    return sent.where(hit & (F.col("sentence") != "")).groupBy(key, "sentence").agg(F.min("pos").alias("pos")).select(key, "pos", "sentence")
