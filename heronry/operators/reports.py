"""Report tables: crosstabs, splits, replicates, rankings side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import average_rank, composite, portable_random, ratio, sign_type
from heronry.operators.replicates import chosen_of_each


def conditional_signs(rows: DataFrame, keys: Sequence[str], reversal: str, negative: str) -> DataFrame:
    """Per key: the 2 x 2 counts, the share of negatives among reversals and among others, and their difference. NULLs are left out."""
    a, b = F.col(reversal), F.col(negative)
    out = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count_if(a & b).alias("rev_neg"), F.count_if(a & ~b).alias("rev_only"), F.count_if(~a & b).alias("neg_only"), F.count_if(~a & ~b).alias("neither"))
    out = out.withColumn("given_reversal", ratio(F.col("rev_neg"), F.col("rev_neg") + F.col("rev_only"))).withColumn("given_other", ratio(F.col("neg_only"), F.col("neg_only") + F.col("neither")))
    return out.withColumn("difference", F.col("given_reversal") - F.col("given_other"))


def decades(rows: DataFrame, value: str) -> DataFrame:
    """(decade, n): how many sizes lie in [10^decade, 10^(decade + 1)); NULL holds the zeros."""
    size = F.abs(value)
    return rows.where(F.col(value).isNotNull()).groupBy(F.when(size > 0, F.floor(F.log10(size))).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(rows: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float]) -> DataFrame:
    """(keys, q, v): quantiles of a value, one row each."""
    out = rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in at])).alias("v"))
    return out.select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in at]).alias("q"), "v")).alias("p")).select(*keys, "p.q", "p.v")


def position_flags(rows: DataFrame, key: str, positions: str) -> DataFrame:
    """(key, n_kinds, n_positions, any_short, any_dropped) from JSON objects of lists of positions: short has 10 to 19, dropped under 10."""
    sizes = F.transform(F.map_values(F.from_json(positions, "map<string,array<long>>")), lambda v: F.size(v))
    flat = rows.select(key, sizes.alias("s"))
    return flat.select(key, F.size("s").alias("n_kinds"), F.aggregate("s", F.lit(0), lambda a, x: a + x).alias("n_positions"), F.exists("s", lambda x: (x >= 10) & (x < 20)).alias("any_short"), F.exists("s", lambda x: x < 10).alias("any_dropped"))


def coverage(flags: DataFrame) -> DataFrame:
    """One row: series, those with a short list, with a dropped one, and positions in all."""
    return flags.agg(F.count(F.lit(1)).alias("series"), F.count_if("any_short").alias("short"), F.count_if("any_dropped").alias("dropped"), F.sum("n_positions").alias("positions"))


def session_summary(spans: DataFrame) -> DataFrame:
    """Per trace: turns, those of people, rejected ones, and the share of each."""
    out = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("kind") == "human").alias("human"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return out.withColumn("human_ratio", ratio(F.col("human"), F.col("turns"))).withColumn("rejected_ratio", ratio(F.col("rejected"), F.col("turns")))


def order_by_index(attr: DataFrame) -> DataFrame:
    """``most`` and ``least``: ranks by value, ties in both by the smaller segment first."""
    w = Window.partitionBy("series_id")
    return attr.withColumn("most", F.row_number().over(w.orderBy(F.desc("value"), "seg"))).withColumn("least", F.row_number().over(w.orderBy("value", "seg")))


def nearest_to_quantiles(rows: DataFrame, group: str, key: str, value: str, at: Sequence[float]) -> DataFrame:
    """(group, q, key): for each quantile in turn the row whose value is nearest, rows already taken left out; ties by key.

    The rows that can be taken are the nearest few of each quantile, as many as there are quantiles.
    """
    q = quantiles(rows, [group], F.col(value), at).withColumnRenamed("v", "_v")
    near = rows.join(F.broadcast(q), group).withColumn("_d", F.round(F.abs(F.col(value) - F.col("_v")), 9))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(group, "q").orderBy("_d", key))).where(F.col("_r") <= len(at))
    lists = near.groupBy(group, "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(key).alias("k")))), lambda x: x["k"]).alias("ks"))
    packed = lists.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("q", "ks"))).alias("c"))
    kind = rows.schema[key].dataType.simpleString()
    start = F.array().cast(f"array<struct<q:double,k:{kind}>>")
    taken = F.aggregate("c", start, lambda done, x: F.concat(done, F.array(F.struct(x["q"].alias("q"), F.get(F.filter(x["ks"], lambda k: ~F.exists(done, lambda y: y["k"] == k)), 0).alias("k")))))
    return packed.select(group, F.explode(taken).alias("t")).select(group, "t.q", F.col("t.k").alias(key)).where(F.col(key).isNotNull())


def most_common(rows: DataFrame, value: str, seq: str, k: int) -> DataFrame:
    """(value, n): the k most frequent, the first seen of equals; the limit is the feature."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def replicate_cells(values: DataFrame) -> DataFrame:
    """Per replicate, operator and method, from rows (k, op, am, unit, v): n, mean, PES, CMI, sign type and rank of the mean among methods."""
    out = values.groupBy("k", "op", "am").agg(F.count("v").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.avg(F.signum("v")), 9).alias("pes"))
    out = out.withColumn("cmi", composite(F.col("mean"), F.col("pes"))).withColumn("sign_type", sign_type(F.col("mean"), F.col("pes")))
    return out.withColumn("rank", average_rank(F.col("mean"), ["k", "op"]))


def tie_replicates(rows: DataFrame, keys: Sequence[str], seq: str, replicates: int, *, seed: int = 7, together: bool = False) -> DataFrame:
    """(k, keys, rest of the row): of rows that share ``keys`` one in each replicate k, by seeded hash; replicate 0 takes the first, as was stored.

    ``together``: such rows share a partition already, and aren't moved again.
    """
    return chosen_of_each(rows, keys, seq, range(replicates + 1), seed=seed, together=together)


def replicate_summary(cells: DataFrame, baseline: str) -> DataFrame:
    """Per operator and method over replicates k > 0: times ranked exactly first, times tied for it, range of the mean, and how often it exceeds the baseline's largest."""
    reps = cells.where("k > 0")
    top = reps.where(F.col("am") == baseline).groupBy("op").agg(F.max("mean").alias("_base"))
    return reps.join(F.broadcast(top), "op", "left").groupBy("op", "am").agg(F.count_if(F.col("rank") == 1).alias("firsts"), F.count_if((F.col("rank") > 1) & (F.col("rank") < 2)).alias("tied_firsts"), F.min("mean").alias("least"), F.median("mean").alias("med"), F.max("mean").alias("most"), F.count_if(F.col("mean") > F.col("_base")).alias("above_baseline"))


def concordance(ranks: DataFrame, keys: Sequence[str], rater: str, item: str) -> DataFrame:
    """(keys, raters, items, w): Kendall's W of each group of rank matrices, NULL with fewer than two items or raters."""
    sums = ranks.groupBy(*keys, item).agg(F.sum("rank").alias("_s"), F.countDistinct(rater).alias("_m"))
    out = sums.groupBy(*keys).agg(F.max("_m").alias("raters"), F.count(F.lit(1)).alias("items"), F.var_pop("_s").alias("_v"))
    m, n = F.col("raters"), F.col("items")
    return out.withColumn("w", F.when((n > 1) & (m > 1), F.lit(12.0) * F.col("_v") * n / (m * m * (n * n * n - n)))).drop("_v")


def override_ranks(main: DataFrame, other: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, item, rank, rank_override): ranks by ``value``, and again where ``other`` replaces some values."""
    j = main.join(other.withColumnRenamed("value", "_o"), [*keys, item], "left").withColumn("_v", F.coalesce("_o", "value"))
    return j.select(*keys, item, average_rank(F.col("value"), list(keys)).alias("rank"), average_rank(F.col("_v"), list(keys)).alias("rank_override"))


def rank_agreement(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, n, rho): Spearman's correlation of two columns of ranks; NULL if one is constant."""
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(varies, F.corr(a, b)).alias("rho"))


def split_medians(rows: DataFrame, keys: Sequence[str], split: str, value: str, unit: str) -> DataFrame:
    """Per key and value of the split: different units, and the median over units of their medians."""
    each = rows.groupBy(*keys, split, unit).agg(F.median(value).alias("_m"))
    return each.groupBy(*keys, split).agg(F.countDistinct(unit).alias("units"), F.median("_m").alias("med"))


def residual_check(rows: DataFrame, keys: Sequence[str], predicted: Column, seen: Column, tolerance: float) -> DataFrame:
    """Per key: cases, share within the tolerance, mismatches, and the residual's largest, 99th percentile, median and zeros."""
    r = F.abs(predicted - seen)
    out = rows.withColumn("_r", r).groupBy(*keys).agg(F.count("_r").alias("cases"), F.avg((F.col("_r") <= tolerance).cast("double")).alias("match_rate"), F.count_if(F.col("_r") > tolerance).alias("mismatches"), F.max("_r").alias("largest"), F.percentile("_r", F.array(F.lit(0.99), F.lit(0.5))).alias("_q"), F.count_if(F.col("_r") == 0).alias("zeros"))
    return out.withColumn("q99", F.get("_q", 0)).withColumn("med", F.get("_q", 1)).drop("_q")


def listed(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows, each with how many more there are: a list for a report, the limit is the feature."""
    top = rows.orderBy(*order).limit(most)
    rest = rows.agg(F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - F.lit(most)).alias("more"))
    return top.crossJoin(F.broadcast(rest))  # one row of a count


def binned(rows: DataFrame, value: str, edges: Sequence[float], *measures: Column) -> DataFrame:
    """(bin, measures): rows in the bins (edge, next edge]; those outside have NULL."""
    label = F.lit(None).cast("string")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        label = F.when((F.col(value) > lo) & (F.col(value) <= hi), F.lit(f"({lo:g},{hi:g}]")).otherwise(label)
    return rows.groupBy(label.alias("bin")).agg(*measures)


def version_table(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Two analyses side by side: (keys, <column>_a, <column>_b, <column>_changed)."""
    side = lambda d, s: d.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    j = side(a, "a").join(side(b, "b"), list(keys), "full")
    return j.select(*keys, *[x for c in columns for x in (f"{c}_a", f"{c}_b", (~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_changed"))])


def relevance(deltas: DataFrame, *, signed: bool) -> DataFrame:
    """(series_id, seg, value, share): each segment's mean change, signed or not, and its part of the series' total size."""
    v = deltas.groupBy("series_id", "seg").agg(F.avg("delta" if signed else F.abs("delta")).alias("value"))
    total = F.sum(F.abs("value")).over(Window.partitionBy("series_id"))
    return v.withColumn("share", ratio(F.col("value"), total))


def class_effects(windows: DataFrame) -> DataFrame:
    """(class, n, mean_change, false_alarms, exact): per class of window (interior, boundary, untouched), from rows (class, before, after, threshold)."""
    change = F.col("after") - F.col("before")
    return windows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg(change).alias("mean_change"), F.count_if((F.col("after") > F.col("threshold")) & (F.col("before") <= F.col("threshold"))).alias("false_alarms"), F.count_if(F.col("after") == F.col("before")).alias("exact"))


def synthetic(spark, n: int, bumps: Sequence[int], *, length: int = 40, height: float = 2.5, seed: int = 7) -> DataFrame:
    """(series_id, idx, x, label): a sine with seeded noise and bumps, labelled."""
    one = spark.range(1).select(F.col("id").alias("series_id"), F.lit(n).cast("long").alias("n"), F.array(*[F.lit(int(b)).cast("long") for b in bumps]).cast("array<bigint>").alias("bumps"))
    return synthetic_series(one, length=length, height=height, seed=seed)


def synthetic_series(plans: DataFrame, *, length: int = 40, height: float = 2.5, seed: int = 7) -> DataFrame:
    """(series_id, idx, x, label) of n points for each of ``plans`` (series_id, n, bumps: where bumps begin)."""
    each = plans.where("n > 0").select("series_id", "bumps", F.explode(F.expr("sequence(0L, n - 1)")).alias("idx"))
    inside = F.exists("bumps", lambda b: (F.col("idx") >= b) & (F.col("idx") < b + length))
    noise = (portable_random(F.lit(seed), F.col("idx")) - 0.5) * 0.1
    return each.select("series_id", "idx", (F.sin(F.col("idx") / F.lit(20.0)) + noise + F.when(inside, height).otherwise(0.0)).alias("x"), inside.cast("int").alias("label"))
