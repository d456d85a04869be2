"""Validation of scores, runs, curves and plans; gates and envelopes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import portable_random


def score_status(scores: DataFrame, layouts: DataFrame, *, constant: str = "flag") -> DataFrame:
    """(series_id, status, constant): missing, bad_length, not_finite, constant or ok, for each layout.

    A constant series has the status ``constant`` only if that option says "error"; the flag is set either way.
    """
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    got = scores.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), (F.min("score") == F.max("score")).alias("constant"))
    j = layouts.select("series_id", "n").join(got, "series_id", "left")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") != F.col("n"), "bad_length").when(F.col("bad") > 0, "not_finite")
    if constant == "error":
        status = status.when(F.col("constant"), "constant")
    return j.select("series_id", status.otherwise("ok").alias("status"), (F.coalesce("constant", F.lit(False)) & (F.coalesce("bad", F.lit(0)) == 0)).alias("constant"))


def validated(scores: DataFrame, layouts: DataFrame, *, constant: str = "flag") -> DataFrame:
    """The scores; a series that isn't ok is an error when it is read."""
    status = score_status(scores, layouts, constant=constant)
    j = scores.join(status.drop("constant"), "series_id", "left")
    return j.select("series_id", "idx", F.when(F.coalesce("status", F.lit("unknown")) == "ok", F.col("score")).otherwise(F.raise_error(F.format_string("series %s: %s", F.col("series_id").cast("string"), F.coalesce("status", F.lit("unknown")))).cast("double")).alias("score"))


def same_rows_twice(run: Callable[[], DataFrame]) -> bool:
    """Whether two runs give the same rows, each as often."""
    a, b = run(), run()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def preflight(jobs: DataFrame, cost: Column, ceiling: Column | float) -> DataFrame:
    """Jobs with ``estimate`` and ``admitted``: whether the estimate, made before anything runs, is within the ceiling; an unknown one isn't."""
    limit = ceiling if isinstance(ceiling, Column) else F.lit(float(ceiling))
    return jobs.withColumn("estimate", cost).withColumn("admitted", F.coalesce(F.col("estimate") <= limit, F.lit(False)))


def within_envelope(rows: DataFrame, inside: Column, value: Column, *, mode: str = "reject") -> DataFrame:
    """Rows with ``output`` and ``status``: ok, or out_of_envelope where the condition is false or undefined.

    "reject" gives such rows no output; "warn" computes it all the same.
    """
    if mode not in ("reject", "warn"):
        raise ValueError(f"unknown mode {mode!r}")
    ok = F.coalesce(inside, F.lit(False))
    return rows.withColumn("output", value if mode == "warn" else F.when(ok, value)).withColumn("status", F.when(ok, "ok").otherwise("out_of_envelope"))


def run_faults(runs: DataFrame) -> DataFrame:
    """(series_id, a, b, fault): runs (series_id, a, b, n) that are empty, out of bounds, or overlap the one before."""
    before = F.max("b").over(Window.partitionBy("series_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fault = F.when(F.col("b") <= F.col("a"), "empty").when((F.col("a") < 0) | (F.col("b") > F.col("n")), "out_of_bounds").when(F.col("a") < before, "overlap")
    return runs.withColumn("fault", fault).where("fault IS NOT NULL").select("series_id", "a", "b", "fault")


def curve_fault(morf: Column, lerf: Column) -> Column:
    """Why two curves can't be compared: length, too_short, not_finite; NULL if they can."""
    odd = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.size(morf) != F.size(lerf), "length").when(F.size(morf) < 2, "too_short").when(odd(morf) | odd(lerf), "not_finite")


def primary_slice(rows: DataFrame, condition: Column, expected: int) -> DataFrame:
    """The rows of the primary condition; another number than expected is an error when it is read."""
    chosen = rows.where(condition)
    n = chosen.agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") == expected, F.lit(True)).otherwise(F.raise_error(F.format_string("%d rows, not %d", F.col("_n"), F.lit(expected))).cast("boolean"))
    return chosen.crossJoin(F.broadcast(n)).where(ok).drop("_n")  # one row of a count


def approval_text(settings: Mapping[str, object]) -> str:
    """The sign-off line of a report: who approved the conventions and when, or that nobody has."""
    who, when = settings.get("approved_by"), settings.get("approved_on")
    return f"approved by {who} on {when}" if who and when else "not approved"


def approval(by: Column, on: Column) -> Column:
    """The same line for each row: a name and a date, either null or empty where nobody has signed."""
    who, when = F.nullif(by.cast("string"), F.lit("")), F.nullif(on.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("approved by "), who, F.lit(" on "), when), F.lit("not approved"))


def family_labels(entities: DataFrame, families: DataFrame, labels: Mapping[str, str], medical: Sequence[str]) -> DataFrame:
    """(entity, family, label, is_medical): an entity's family and its short label; a family without one is an error.

    An entity without a family has NULL throughout.
    """
    j = entities.select("entity").join(families, "entity", "left")
    label = F.lit(None).cast("string")
    for k, v in labels.items():
        label = F.when(F.col("family") == k, F.lit(v)).otherwise(label)
    known = F.col("family").isNull() | F.col("family").isin(*labels)
    return j.select("entity", "family", F.when(known, label).otherwise(F.raise_error(F.format_string("unknown family %s", F.col("family")))).alias("label"), F.col("family").isin(*medical).alias("is_medical"))


def score_diagnostics(scores: DataFrame, self_scores: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, support_max, self_match_max, train_p99): largest score over the labelled interval's windows and against itself, and the training tail."""
    j = scores.join(layouts, "series_id")
    near = (F.col("idx") >= F.col("s0") - F.col("w")) & (F.col("idx") < F.col("s1") + F.col("w"))
    out = j.groupBy("series_id").agg(F.max(F.when(near, F.col("score"))).alias("support_max"), F.percentile(F.when(F.col("idx") < F.col("te"), F.col("score")), F.lit(0.99)).alias("train_p99"))
    own = self_scores.groupBy("series_id").agg(F.max("score").alias("self_match_max"))
    return out.join(own, "series_id", "left").select("series_id", "support_max", "self_match_max", "train_p99")


def dispatch(detectors: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]], name: str, series: DataFrame, layouts: DataFrame) -> DataFrame:
    """Scores of the detector of that name, with ``detector``; an unknown name is an error."""
    if name not in detectors:
        raise ValueError(f"unknown detector {name!r}; one of {sorted(detectors)}")
    return detectors[name](series, layouts).withColumn("detector", F.lit(name))


def mean_of_windows(scores: DataFrame, layouts: DataFrame, how: str = "mean") -> DataFrame:
    """(series_id, idx, score) from window scores (series_id, start, score): the mean, largest or sum over the windows that hold a point."""
    agg = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    held = scores.join(layouts.select("series_id", "w"), "series_id").select("series_id", F.explode(F.expr("sequence(start, start + w - 1)")).alias("idx"), "score")
    return held.groupBy("series_id", "idx").agg(agg("score").alias("score"))


def added_noise(points: DataFrame, inside: Column, *, level: float = 0.1, seed: int = 7) -> DataFrame:
    """``points`` with ``masked``: normal noise of ``level`` standard deviations added inside the region, by seeded hash."""
    spread = F.stddev_pop("x").over(Window.partitionBy("series_id"))
    u, v = (portable_random(F.lit(seed), F.col("series_id"), F.col("idx"), F.lit(c)) for c in "ab")
    noise = F.lit(level) * spread * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)
    return points.withColumn("masked", F.col("x") + F.when(inside, noise).otherwise(F.lit(0.0)))


def pure_windows(series: DataFrame, n: int, *, w: int, purity: float = 0.5, seed: int = 7) -> DataFrame:
    """(series_id, start, kind): ``n`` windows of w points that are wholly normal, and n with at least ``purity`` labelled points.

    ``series``: (series_id, idx, label). Chosen without replacement by seeded hash.
    """
    ahead = Window.partitionBy("series_id").orderBy("idx").rowsBetween(0, w - 1)
    share = series.withColumn("share", F.avg("label").over(ahead)).withColumn("_n", F.count(F.lit(1)).over(ahead)).where(F.col("_n") == w)
    kind = F.when(F.col("share") == 0, "normal").when(F.col("share") >= purity, "anomalous")
    order = Window.partitionBy("series_id", "kind").orderBy(portable_random(F.lit(seed), F.col("series_id"), F.col("idx")), "idx")
    out = share.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return out.select("series_id", F.col("idx").alias("start"), "kind")


def mismatch_rate(checks: DataFrame, keys: Sequence[str], ok: Column, *, stop: float = 0.01) -> DataFrame:
    """Per key: cases, share that match, mismatches, and whether their share calls for a stop. An undefined check is a mismatch."""
    good = F.coalesce(ok, F.lit(False))
    out = checks.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.avg(good.cast("double")).alias("match_rate"), F.count_if(~good).alias("mismatches"))
    return out.withColumn("stop", F.lit(1.0) - F.col("match_rate") > stop)


def assertions(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, failed, passes): how many rows break each rule, in one pass; a rule that comes out NULL is broken."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules])).alias("r")).select("r.*")
    return out.withColumn("passes", F.col("failed") == 0)


def sample_counts(layouts: DataFrame, segments: DataFrame) -> DataFrame:
    """(series_id, k, method, samples): model calls an explanation takes: 2K + 2048 coalitions for Shapley values, K + 1 for ablation, 25 for smoothing."""
    k = segments.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"))
    plan = F.array(*[F.struct(F.lit(m).alias("method"), c.cast("long").alias("samples")) for m, c in (("shap", 2 * F.col("k") + 2048), ("ablation", F.col("k") + 1), ("smooth", F.lit(25)))])
    return layouts.select("series_id").join(k, "series_id").select("series_id", "k", F.explode(plan).alias("p")).select("series_id", "k", "p.method", "p.samples")


def fitted_to_length(scores: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, idx, score): scores of a series that are fewer or more than its points, brought to n by linear interpolation."""
    packed = scores.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "score"))), lambda p: p["score"]).alias("v")).join(layouts.select("series_id", "n"), "series_id")
    at = F.transform(F.expr("sequence(0L, n - 1)"), lambda k: k * (F.size("v") - 1) / F.greatest(F.lit(1), F.col("n") - 1).cast("double"))

    def value(p: Column) -> Column:
        low = F.floor(p).cast("int")
        high = F.least(low + 1, F.size("v") - 1)
        return F.get("v", low) + (F.get("v", high) - F.get("v", low)) * (p - low)

    same = F.size("v") == F.col("n")
    return packed.select("series_id", F.posexplode(F.when(same, F.col("v")).otherwise(F.transform(at, value))).alias("idx", "score")).withColumn("idx", F.col("idx").cast("long"))


def hyperparameters(spark, conditions: Mapping[str, Mapping[str, object]], detector: str) -> DataFrame:
    """(condition, detector, window, tag, settings): one row a condition; the window is its own or 100, the tag says the variant of max_features."""
    rows = []
    for name, given in conditions.items():
        features = given.get("max_features")
        tag = "none" if features is None else f"mf{features}" if isinstance(features, int) else f"mf{float(features):.1f}f"
        rows.append((name, detector, int(given.get("window", 100)), tag, ",".join(f"{k}={given[k]}" for k in sorted(given))))
    return spark.createDataFrame(rows, "condition string, detector string, window int, tag string, settings string")


def zero_class(predictions: DataFrame) -> DataFrame:
    """Per operator, from rows (op, before, after: arrays of class scores): how many change their class, and how many then fall into class 0."""
    top = lambda v: F.array_position(v, F.array_max(v)) - 1
    c = predictions.select("op", top(F.col("before")).alias("b"), top(F.col("after")).alias("a"))
    return c.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if((F.col("a") != F.col("b")) & (F.col("a") == 0)).alias("to_zero"), F.count_if(F.col("a") == 0).alias("zero"))


def footprints(layouts: DataFrame, length: Column) -> DataFrame:
    """(series_id, a, b, reach_a, reach_b): each region of that length in the certainly normal stretches, and the points its change can reach."""
    from heronry.operators.series import admissible, influence

    starts = layouts.withColumn("_len", length.cast("long")).withColumn("_r", F.explode(admissible(F.col("_len"))))
    at = starts.withColumn("a", F.explode(F.sequence(F.col("_r.lo"), F.col("_r.hi")))).withColumn("b", F.col("a") + F.col("_len"))
    lo, hi = influence(F.col("a"), F.col("b"), F.col("w"))
    return at.select("series_id", "a", "b", lo.alias("reach_a"), hi.alias("reach_b"))


def effect_plan(layouts: DataFrame, lengths: Sequence[int], *, least: int = 10, enough: int = 20) -> DataFrame:
    """(series_id, region, len, n, status): the anomaly, and normal regions of each length that fit without overlap.

    Fewer than ``least`` normal ones and the length is dropped; fewer than ``enough`` and it is short.
    """
    from heronry.operators.series import max_disjoint

    k = layouts.withColumn("len", F.explode(F.array(*[F.lit(int(v)).cast("long") for v in lengths]))).withColumn("n", F.least(F.lit(enough).cast("long"), max_disjoint(F.col("len"))))
    status = F.when(F.col("n") < least, "dropped").when(F.col("n") < enough, "short").otherwise("full")
    normal = k.select("series_id", F.lit("normal").alias("region"), "len", "n", status.alias("status"))
    return normal.union(layouts.select("series_id", F.lit("anomaly"), (F.col("s1") - F.col("s0")), F.lit(1).cast("long"), F.lit("full")))


def dominant_period(series: DataFrame, low: int, high: int) -> DataFrame:
    """(series_id, period, corr): the lag from ``low`` to ``high`` with the largest correlation of a series with itself; the smallest of equals."""
    later = series.select("series_id", F.col("idx").alias("_i"), F.col("x").alias("_y"))
    lagged = series.select("series_id", "idx", "x", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag")).withColumn("_i", F.col("idx") + F.col("lag"))
    r = lagged.join(later, ["series_id", "_i"]).groupBy("series_id", "lag").agg(F.when((F.count(F.lit(1)) > 2) & (F.max("x") > F.min("x")) & (F.max("_y") > F.min("_y")), F.round(F.corr("x", "_y"), 6)).alias("corr"))
    return r.where("corr IS NOT NULL").groupBy("series_id").agg(F.min_by("lag", F.struct(-F.col("corr"), "lag")).alias("period"), F.max("corr").alias("corr"))
