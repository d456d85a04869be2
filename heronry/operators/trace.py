"""Span logs: trajectory, component and system summaries, roll-ups, budgets, lifecycle decisions.

Spans are rows (trace_id, span_id, parent_id, seq, name, kind, component, component_version, status, started_at,
ended_at, input_tokens, output_tokens, peak_vram_mb, absorbed_tokens, emitted_tokens, attributes: map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import ratio
from heronry.operators.tables import ranked
from heronry.shared import written

MODEL_KIND, CONTROL_KINDS = "model", ("control", "selection")


def _control() -> Column:
    return F.col("kind").isin(*CONTROL_KINDS)


def _round_ratio(a: Column, b: Column, places: int) -> Column:
    return F.round(a.cast("double") / F.greatest(b, F.lit(1)).cast("double"), places)


def trace_report(spans: DataFrame) -> DataFrame:
    """One row: counts, isolation, control ratio, retries, and tokens and wall seconds of root spans."""
    root = F.col("parent_id").isNull()
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    control, model = F.count_if(_control()), F.count_if(F.col("kind") == MODEL_KIND)
    return spans.agg(
        F.countDistinct("trace_id").alias("traces"),
        F.count(F.lit(1)).alias("spans"),
        _round_ratio(F.sum(F.coalesce("absorbed_tokens", F.lit(0))), F.sum(F.coalesce("emitted_tokens", F.lit(0))), 2).alias("isolation"),
        F.round(ratio(control, control + model), 3).alias("control_ratio"),
        F.count_if(F.col("name").startswith("refine:round")).alias("retries"),
        F.sum(F.when(root, tokens).otherwise(0)).alias("tokens"),
        F.round(F.sum(F.when(root, F.col("ended_at") - F.col("started_at")).otherwise(0.0)), 6).alias("wall_seconds"),
        F.max(F.coalesce("peak_vram_mb", F.lit(0.0))).alias("peak_vram_mb"),
    )


def invocations(spans: DataFrame) -> DataFrame:
    """Calls of each component version, most first."""
    named = spans.where(F.col("component").isNotNull() & F.col("component_version").isNotNull())
    return named.groupBy("component", "component_version").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def trajectory_summary(spans: DataFrame) -> DataFrame:
    """Per trace: spans, control and model counts, control ratio, tokens absorbed and emitted, isolation, failures, duration."""
    control, model = F.count_if(_control()), F.count_if(F.col("kind") == MODEL_KIND)
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        ratio(control, control + model).alias("control_ratio"),
        F.sum(F.coalesce("absorbed_tokens", F.lit(0))).alias("absorbed"),
        F.sum(F.coalesce("emitted_tokens", F.lit(0))).alias("emitted"),
        (F.sum(F.coalesce("absorbed_tokens", F.lit(0))).cast("double") / F.greatest(F.sum(F.coalesce("emitted_tokens", F.lit(0))), F.lit(1)).cast("double")).alias("isolation"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.round(F.max("ended_at") - F.min("started_at"), 6).alias("duration"),
    )


def system_summary(spans: DataFrame) -> DataFrame:
    """Per component: its last version, calls, and tokens at root spans only."""
    root = F.col("parent_id").isNull()
    return spans.where(F.col("component").isNotNull()).groupBy("component").agg(F.max_by("component_version", "seq").alias("version"), F.count(F.lit(1)).alias("calls"), F.sum(F.when(root, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).otherwise(0)).alias("root_tokens"))


def ancestors(spans: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """(trace_id, span_id, ancestor): every span with itself and all above it, however deep. A cycle is an error.

    Distances double each round (a span's ancestors' ancestors), so a chain of length d takes log2 d joins. Each round is
    written to the shared folder, so plans don't grow.
    """
    up = spans.where(F.col("parent_id").isNotNull()).select("trace_id", "span_id", F.col("parent_id").alias("ancestor"))
    closure = step = written(up, "ancestors")
    met = (F.col("s.trace_id") == F.col("t.trace_id")) & (F.col("s.ancestor") == F.col("t.span_id"))
    for _ in range(most_rounds):  # 2 ** 40 levels: deeper than any tree
        hop = written(step.alias("s").join(step.alias("t"), met).select("s.trace_id", "s.span_id", "t.ancestor"), "ancestors")
        closure = written(closure.union(closure.alias("s").join(step.alias("t"), met).select("s.trace_id", "s.span_id", "t.ancestor")).distinct(), "ancestors")
        if not closure.where("span_id = ancestor").isEmpty():
            raise ValueError("a span is its own ancestor")
        if hop.isEmpty():
            return closure.union(spans.select("trace_id", "span_id", F.col("span_id").alias("ancestor")))
        step = hop
    raise ValueError("spans are nested too deeply")


def usage_rollup(spans: DataFrame) -> DataFrame:
    """Tokens summed and memory maximised over each span's subtree; wall seconds are the span's own."""
    own = spans.select("trace_id", "span_id", (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("t"), F.coalesce("peak_vram_mb", F.lit(0.0)).alias("v"))
    sums = ancestors(spans).join(own, ["trace_id", "span_id"]).groupBy("trace_id", F.col("ancestor").alias("span_id")).agg(F.sum("t").alias("tokens"), F.max("v").alias("peak_vram_mb"), F.count(F.lit(1)).alias("subtree"))
    return sums.join(spans.select("trace_id", "span_id", F.round(F.col("ended_at") - F.col("started_at"), 6).alias("wall_seconds")), ["trace_id", "span_id"])


def selections(spans: DataFrame) -> DataFrame:
    """(task_key, chosen): the last selection of each task."""
    s = spans.where((F.col("kind") == "selection") & F.col("attributes")["task_key"].isNotNull())
    return s.groupBy(F.col("attributes")["task_key"].alias("task_key")).agg(F.max_by(F.col("attributes")["chosen"], "seq").alias("chosen"))


def cases_from_trace(spans: DataFrame) -> DataFrame:
    """Spans a person saw or that were rejected, as test cases with the corrected output where there is one."""
    keep = (F.col("kind") == "human") | (F.col("status") == "rejected")
    return spans.where(keep).select("trace_id", "span_id", "name", F.coalesce(F.col("attributes")["corrected"], F.col("attributes")["chosen"]).alias("expected"))


def pattern_counts(spans: DataFrame) -> DataFrame:
    """Uses of each control pattern, and its last justification."""
    p = spans.where(F.col("attributes")["pattern"].isNotNull())
    return p.groupBy(F.col("attributes")["pattern"].alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.col("attributes")["justification"], "seq").alias("justification"))


def suite_report(runs: DataFrame) -> DataFrame:
    """One row over runs (success, tokens, seconds): success rate, tokens a task, successes per 1,000 tokens."""
    out = runs.agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("tokens").alias("tokens_per_task"), F.avg("seconds").alias("seconds_per_task"))
    return out.withColumn("success_per_1k", ratio(F.col("success_rate"), F.col("tokens_per_task") / 1000))


def swap_survival(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of (component, version) pairs of ``before`` that ``after`` still has."""
    b, a = before.select("component", "version").distinct(), after.select("component", "version").distinct()
    kept = b.join(a.withColumn("_k", F.lit(1)), ["component", "version"], "left")
    return kept.agg(F.count(F.lit(1)).alias("before"), F.count("_k").alias("kept"), F.coalesce(ratio(F.count("_k"), F.count(F.lit(1))), F.lit(1.0)).alias("survival"))


def retirement(versions: DataFrame, uses: DataFrame) -> DataFrame:
    """Versions never used of components that have several."""
    n = F.count(F.lit(1)).over(Window.partitionBy("component"))
    used = uses.groupBy("component", "version").agg(F.count(F.lit(1)).alias("uses"))
    return versions.select("component", "version").distinct().withColumn("_n", n).join(used, ["component", "version"], "left").where("_n > 1 AND uses IS NULL").select("component", "version")


def latest_version(versions: DataFrame) -> DataFrame:
    """The version that is last as text (so "1.10" comes before "1.9") among those not deprecated."""
    return versions.where(~F.coalesce("deprecated", F.lit(False))).groupBy("component").agg(F.max("version").alias("version"))


def component_scores(cases: DataFrame) -> DataFrame:
    """Per component: accuracy on cases inside its envelope, precision of refusing those outside (1 if none was refused), errors, tokens."""
    inside = ~F.col("out_of_envelope")
    refused, right = F.col("refused"), F.col("output").eqNullSafe(F.col("expected"))
    return cases.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(ratio(F.count_if(inside & ~refused & right), F.count_if(inside)), F.lit(0.0)).alias("accuracy"),
        F.coalesce(ratio(F.count_if(refused & ~inside), F.count_if(refused)), F.lit(1.0)).alias("envelope_precision"),
        F.count_if(F.col("error")).alias("errors"),
        F.sum("tokens").alias("tokens"),
    )


def swap_decision(scores: DataFrame, *, min_gain: float = 0.02, token_factor: float = 1.5) -> DataFrame:
    """First rule that holds: floor unmet, no better than the baseline, no incumbent, too small a gain, too dear, else promote."""
    gain = F.col("accuracy") - F.col("incumbent_accuracy")
    d = (
        F.when(F.col("accuracy") < F.col("floor"), "rollback")
        .when(F.col("accuracy") <= F.col("baseline"), "unjustified")
        .when(F.col("incumbent_accuracy").isNull(), "promote")
        .when(gain < min_gain, "keep")
        .when((F.col("incumbent_tokens") > 0) & (F.col("tokens") > token_factor * F.col("incumbent_tokens")), "keep")
        .otherwise("promote")
    )
    return scores.withColumn("decision", d)


def judge_calibration(verdicts: DataFrame, labels: DataFrame, *, least: int = 30, agreement: float = 0.8) -> DataFrame:
    """Per judge against labelled cases: agreement, false passes and fails, and whether it may be used."""
    j = verdicts.join(labels, "case_id")
    out = j.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("passed") == F.col("label")).cast("double")).alias("agreement"), F.count_if(F.col("passed") & ~F.col("label")).alias("false_pass"), F.count_if(~F.col("passed") & F.col("label")).alias("false_fail"))
    return out.withColumn("usable", (F.col("n") >= least) & (F.col("agreement") >= agreement))


def budget(spends: DataFrame, limits: DataFrame) -> DataFrame:
    """Running spend of each node and all its children against the node's limit: (node, seq, spent, left, over)."""
    w = Window.partitionBy("node").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return spends.withColumn("spent", F.sum("tokens").over(w)).join(limits, "node").select("node", "seq", "spent", (F.col("limit") - F.col("spent")).alias("left"), (F.col("spent") > F.col("limit")).alias("over"))


def workers_allowed(wanted: Column, most: Column) -> Column:
    return F.least(F.greatest(wanted, F.lit(1)), most)


def quorum(panel: DataFrame, present: DataFrame) -> DataFrame:
    """Per case: full, degraded or halted. ``panel``: (role, need, required, halts); ``present``: (case_id, role).

    A required role that is missing halts if it says so and degrades if not; a role that isn't required and has nobody
    at all halts; too few of a role degrade.
    """
    have = present.groupBy("case_id", "role").agg(F.count(F.lit(1)).alias("have"))
    j = present.select("case_id").distinct().crossJoin(panel).join(have, ["case_id", "role"], "left").fillna({"have": 0})
    none = F.col("have") == 0
    out = j.groupBy("case_id").agg(F.max(none & F.col("required") & F.col("halts")).alias("h1"), F.max(none & ~F.col("required") & (F.col("need") > 0)).alias("h2"), F.max(F.col("have") < F.col("need")).alias("short"))
    return out.select("case_id", F.when(F.col("h1") | F.col("h2"), "halted").when(F.col("short"), "degraded").otherwise("full").alias("decision"))


def memory_view(log: DataFrame, now: float) -> DataFrame:
    """(subject, key, value): the latest entry of each key that hasn't expired at ``now`` and wasn't forgotten with its subject."""
    latest = log.groupBy("subject", "key").agg(F.max_by(F.struct("value", "created_at", "ttl_seconds", "op"), "seq").alias("v"))
    alive = F.col("v.ttl_seconds").isNull() | (F.lit(now) - F.col("v.created_at") <= F.col("v.ttl_seconds"))
    forgotten = log.where("op = 'forget'").groupBy("subject").agg(F.max("seq").alias("fseq"))
    seqs = log.where("op = 'put'").groupBy("subject", "key").agg(F.max("seq").alias("pseq"))
    out = latest.join(seqs, ["subject", "key"]).join(forgotten, "subject", "left").where(alive & (F.col("fseq").isNull() | (F.col("pseq") > F.col("fseq"))))
    return out.select("subject", "key", F.col("v.value").alias("value"))


def history(turns: DataFrame, n: int, *, subject: str, order: str) -> DataFrame:
    """The last ``n`` turns of each subject."""
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy(subject).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def replay(requests: DataFrame, cassette: DataFrame) -> DataFrame:
    """Recorded answers by key; a request without one is an error when it is read."""
    j = requests.join(cassette, "key", "left")
    return j.withColumn("answer", F.coalesce("answer", F.raise_error(F.format_string("no recording of %s", F.col("key")))))


def distill(examples: DataFrame, *, holdout: float = 0.2) -> DataFrame:
    """Verified examples, the first of each key, with ``part``: the first fifth (one at least) is for evaluation."""
    key = F.substring(F.sha2(F.to_json(F.struct("input", "output")), 256), 1, 16)
    first = examples.where("verified").withColumn("key", key).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("_r = 1").drop("_r")
    n = first.count()
    return ranked(first, ["seq"], "_rank").withColumn("part", F.when(F.col("_rank") < max(1, int(n * holdout)), "eval").otherwise("train")).drop("_rank")


def distill_entry(calls: DataFrame, *, least_calls: int = 100, least_variety: int = 10) -> DataFrame:
    """Per component: calls, different signatures less one, and whether both suffice."""
    out = calls.groupBy("component").agg(F.count(F.lit(1)).alias("calls"), (F.countDistinct("signature") - 1).alias("variety"))
    return out.withColumn("eligible", (F.col("calls") >= least_calls) & (F.col("variety") >= least_variety))
