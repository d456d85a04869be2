"""Rates over seeds and domains, schedules, registries, boards, and the smaller parts of reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import ratio
from heronry.operators.masking import mask


# --- rates


def means_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): means of doubles added one by one in the stated order, whatever tasks the rows are in.

    A mean near zero has the sign that this order gives it. NULLs are left out. Rows of a group may spill.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*keys, *order, F.avg(value).over(w).alias("_so_far")).groupBy(*keys).agg(F.max_by("_so_far", F.struct(*order)).alias(value))


def in_file_order(rows: DataFrame) -> DataFrame:
    """The columns of a Parquet scan, with ``_file``, the number of the row's file by name, and ``_row``, its place there."""
    path = F.col("_metadata.file_path").alias("_path")
    files = rows.select(path).distinct().withColumn("_file", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_path")))
    return rows.select("*", path, F.col("_metadata.row_index").alias("_row")).join(F.broadcast(files), "_path").drop("_path")


def over_seeds(rows: DataFrame, keys: Sequence[str], seed: str, hit: Column) -> DataFrame:
    """(keys, seeds, least, med, most): the rate of hits of each seed, and its range over seeds."""
    rates = rows.groupBy(*keys, seed).agg(F.avg(hit.cast("double")).alias("_r"))
    return rates.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), F.min("_r").alias("least"), F.median("_r").alias("med"), F.max("_r").alias("most"))


def range_by(rows: DataFrame, key: str, value: str, flagged: Column) -> DataFrame:
    """(key, n, least, med, most, flagged), and a row "all" over everything."""
    out = rows.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.median(value).alias("med"), F.max(value).alias("most"), F.count_if(flagged).alias("flagged"))
    return out.withColumn(key, F.coalesce(F.col(key), F.lit("all")))


def pooled(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, med, above): all values together, and the share above zero; NULLs are left out."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("med"), F.avg((F.col(value) > 0).cast("int")).alias("above"))


def point_estimate(rows: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    """(keys, point): the mean of a rate or the median of sizes; NULL where nothing is known."""
    agg = {"rate": F.avg, "size": F.median}[how]
    return rows.groupBy(*keys).agg(agg(value).alias("point"))


def accuracy(rows: DataFrame, keys: Sequence[str], predicted: str, label: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def value_kinds(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, most, all_whole): a series' range, and whether all its values are whole numbers."""
    return rows.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.min(F.col(value) == F.rint(value)).alias("all_whole"))


def small_counts(rows: DataFrame, keys: Sequence[str], unit: str, least: int = 30) -> DataFrame:
    """(keys, n, units, small): counts, different units, and whether these are too few for more than a description."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(unit).alias("units")).withColumn("small", F.col("units") < least)


def selection_rules(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with a column for each rule, and ``selected``: all hold. An undefined rule doesn't."""
    out = rows.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in rules.items()})
    every = F.lit(True)
    for n in rules:
        every = every & F.col(n)
    return out.withColumn("selected", every)


def failure_summary(calls: DataFrame, name: str) -> DataFrame:
    """(name, calls, failed, failure_rate, seconds): a log of calls (ok, seconds) summed up."""
    return calls.groupBy(name).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.avg((~F.col("ok")).cast("double")).alias("failure_rate"), F.sum("seconds").alias("seconds"))


def tree_hash(files: DataFrame, folder: str) -> DataFrame:
    """(folder, files, sha256): one hash for each folder from its files' names and hashes in the order of names."""
    line = F.concat_ws(" ", "sha256", "filename")
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("filename", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("sha256"))


# --- orders and windows


def longest_first(jobs: DataFrame, key: str, cost: str, group: str) -> DataFrame:
    """Jobs with ``turn``: the most costly of a group first, equal ones by key."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(cost), key)))


def moving_average(series: DataFrame, k: int) -> DataFrame:
    """(series_id, idx, x): the sum over k points about each one over k, as if there were zeros beyond the ends."""
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-(k // 2), k - 1 - k // 2)
    return series.select("series_id", "idx", (F.sum("x").over(w) / F.lit(float(k))).alias("x"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_id, a0, a1, b0, b1): intervals (series_id, lo, hi) of both sides that share a point."""
    left = a.select("series_id", F.col("lo").alias("a0"), F.col("hi").alias("a1"))
    right = b.select("series_id", F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    return left.join(right, "series_id").where("a0 < b1 AND b0 < a1")


def partition_faults(rows: DataFrame, key: str, parts: Mapping[str, Column]) -> DataFrame:
    """(key, n, faults): rows of each key that are in none or several of the parts."""
    hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(hits != 1).alias("faults"))


def excerpt(text: Column, most: int = 400) -> Column:
    """The first characters of a text without blanks at its ends."""
    return F.left(F.trim(text), F.lit(most))


def mask_runs(points: DataFrame, runs: DataFrame, name: str, **options: int) -> DataFrame:
    """``points`` with ``masked``: each of several runs (series_id, a, b) of a series masked, every one from the unmasked values."""
    each = points.drop("a", "b").join(runs.select("series_id", "a", "b", F.monotonically_increasing_id().alias("_run")), "series_id")
    # a run is a series of its own while it is masked
    own = each.withColumn("_id", F.col("series_id")).withColumn("series_id", F.struct("series_id", "_run"))
    inside = mask(own, name, **options).where("idx >= a AND idx < b").select(F.col("_id").alias("series_id"), "idx", F.col("masked").alias("_m"))
    return points.join(inside, ["series_id", "idx"], "left").withColumn("masked", F.coalesce("_m", "x")).drop("_m")


def linear_from_mean(points: DataFrame) -> DataFrame:
    """``points`` with ``masked``: a line across the region between its neighbours; an edge without one starts from the training mean."""
    w, idx = Window.partitionBy("series_id"), F.col("idx")
    mean = F.avg(F.when(idx < F.col("te"), F.col("x"))).over(w)
    first = F.coalesce(F.max(F.when(idx == F.col("a") - 1, F.col("x"))).over(w), mean)
    last = F.coalesce(F.max(F.when(idx == F.col("b"), F.col("x"))).over(w), mean)
    line = first + (last - first) * (idx - F.col("a") + 1) / (F.col("b") - F.col("a") + 1).cast("double")
    return points.withColumn("masked", F.when((idx >= F.col("a")) & (idx < F.col("b")), line).otherwise(F.col("x")))


def erased(points: DataFrame) -> DataFrame:
    """Masked points; a change outside the region is an error when it is read."""
    outside = (F.col("idx") < F.col("a")) | (F.col("idx") >= F.col("b"))
    return points.withColumn("masked", F.when(outside & ~F.col("masked").eqNullSafe(F.col("x")), F.raise_error(F.format_string("series %s changed outside its region", F.col("series_id").cast("string"))).cast("double")).otherwise(F.col("masked")))


def response_change(before: DataFrame, after: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, before, after, ai): the largest score over the region's windows before and after a change, and their difference over the training spread."""
    near = (F.col("idx") > F.col("a") - F.col("w")) & (F.col("idx") < F.col("b") + F.col("w"))
    top = lambda s, n: s.join(layouts, "series_id").where(near).groupBy("series_id").agg(F.max("score").alias(n))
    spread = before.join(layouts, "series_id").where("idx < te").groupBy("series_id").agg(F.stddev_pop("score").alias("_s"))
    j = top(before, "before").join(top(after, "after"), "series_id").join(spread, "series_id")
    return j.select("series_id", "before", "after", ratio(F.col("after") - F.col("before"), F.col("_s")).alias("ai"))


def gate_verdict(lo: Column, hi: Column) -> Column:
    """GO if an interval lies above 0, NO-GO if below, else undecided."""
    return F.when(lo > 0, "GO").when(hi < 0, "NO-GO").otherwise("undecided")


def achievable(scores: DataFrame, *, share: float = 0.1) -> DataFrame:
    """(series_id, idx, o1, o2): even weight on labelled points, and on those of them among the top share of scores; o1 where none is."""
    w = Window.partitionBy("series_id")
    cut = F.percentile("score", F.lit(1.0 - share)).over(w)
    label = F.col("label") == 1
    both = label & (F.col("score") >= F.col("_cut"))
    out = scores.withColumn("_cut", cut)
    even = lambda c: ratio(c.cast("int"), F.sum(c.cast("int")).over(w))
    o1 = F.coalesce(even(label), F.lit(0.0))
    return out.select("series_id", "idx", o1.alias("o1"), F.when(F.sum(both.cast("int")).over(w) > 0, even(both)).otherwise(o1).alias("o2"))


# --- points in time


def availability(points: DataFrame, as_of: Column) -> DataFrame:
    """(key, available): keys with a value known at ``as_of``; others are withheld."""
    known = (F.col("published_at") <= as_of) & (F.col("restated_at").isNull() | (F.col("restated_at") <= as_of))
    return points.groupBy("key").agg(F.max(F.coalesce(known, F.lit(False))).alias("available"))


def required_at(view: DataFrame, keys: DataFrame) -> DataFrame:
    """The view's rows of the keys; one that isn't known is an error when it is read."""
    j = keys.select("key").join(view.withColumn("_k", F.lit(True)), "key", "left")
    ok = F.when(F.coalesce("_k", F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.format_string("%s isn't known yet", F.col("key").cast("string"))).cast("boolean"))
    return j.where(ok).drop("_k")


# --- registries, boards, judges


def registry_report(components: DataFrame, uses: DataFrame) -> DataFrame:
    """(component, role, versions, last, uses, parametric) of rows (component, version, role, rung): a version twice is an error; rung 6 or more is parametric."""
    n = F.count(F.lit(1)).over(Window.partitionBy("component", "version"))
    once = components.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.format_string("%s %s is registered twice", "component", "version")).cast("boolean")))
    out = once.groupBy("component").agg(F.first("role").alias("role"), F.count(F.lit(1)).alias("versions"), F.max("version").alias("last"), F.max(F.col("rung") >= 6).alias("parametric"))
    used = uses.groupBy("component").agg(F.count(F.lit(1)).alias("uses"))
    return out.join(used, "component", "left").select("component", "role", "versions", "last", F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), "parametric")


def board(records: DataFrame, *, floor: float) -> DataFrame:
    """(component, version, accuracy, coverage, passes): the last record (seq) of each component's board, against a floor."""
    last = records.groupBy("component").agg(F.max_by(F.struct("version", "accuracy", "coverage"), "seq").alias("v"))
    return last.select("component", "v.version", "v.accuracy", "v.coverage", (F.coalesce(F.col("v.accuracy") >= floor, F.lit(False))).alias("passes"))


def judged(cases: DataFrame, calibration: DataFrame) -> DataFrame:
    """(judge, case_id, verdict): verdicts of judges that may be used; one that may not gives NULL, and so does one never calibrated."""
    j = cases.join(calibration.select("judge", "usable"), "judge", "left")
    return j.select("judge", "case_id", F.when(F.coalesce("usable", F.lit(False)), F.col("passed")).alias("verdict"))


def verified_ratio(examples: DataFrame, key: str) -> DataFrame:
    """(key, n, verified, ratio)."""
    out = examples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"))
    return out.withColumn("ratio", ratio(F.col("verified"), F.col("n")))


def publishable(entry: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(component, publishable, why): a distilled component needs its entry conditions and a component to fall back on."""
    j = entry.join(fallbacks.select("component", F.lit(True).alias("_f")).distinct(), "component", "left")
    why = F.when(~F.col("eligible"), "entry").when(F.col("_f").isNull(), "no_fallback")
    return j.select("component", why.isNull().alias("publishable"), why.alias("why"))


def diverse(panel: DataFrame, key: str, family: str, least: int) -> DataFrame:
    """(key, families, diverse): whether a panel has enough different families to deliberate."""
    return panel.groupBy(key).agg(F.countDistinct(family).alias("families")).withColumn("diverse", F.col("families") >= least)


def winner(scores: DataFrame, key: str, target: str, seq: str) -> DataFrame:
    """(key, target): the highest score, the first of equals."""
    return scores.groupBy(key).agg(F.max_by(target, F.struct("score", -F.col(seq))).alias(target))


def timed(run: Callable[[], object]) -> tuple[object, str | None, float]:
    """(result, error, seconds) of a call: an error is a value, not an end."""
    import time

    start = time.perf_counter()
    try:
        return run(), None, time.perf_counter() - start
    except Exception as e:  # noqa: BLE001 - that is what the record is for
        return None, f"{type(e).__name__}: {e}", time.perf_counter() - start
