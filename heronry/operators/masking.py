"""Masking operators: replace the points of a region [a, b) and nothing else.

Each takes points (series_id, idx, x) joined to one region a series (a, b) and the layout, and yields ``masked``.
Values come from the unperturbed series only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import portable_random

def _all():
    return Window.partitionBy("series_id")


def inside() -> Column:
    return (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b"))


def _where(condition: Column, value: Column | str = "x") -> Column:
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


def _value(name: str, context: int, seed: int) -> Column:
    x, idx, a, b = F.col("x"), F.col("idx"), F.col("a"), F.col("b")
    mean = F.avg("x").over(_all())
    train = _where(idx < F.col("te"))
    mu, sd = F.avg(train).over(_all()), F.stddev_pop(train).over(_all())
    sd = F.when(sd > 0, sd).otherwise(F.lit(1.0))
    top = F.max(x).over(_all())
    left, right = F.max(_where(idx == a - 1)).over(_all()), F.max(_where(idx == b)).over(_all())
    first, last = F.coalesce(left, right), F.coalesce(right, left)
    if name == "identity":
        return x
    if name == "zero":
        return F.lit(0.0)
    if name == "global_mean":
        return mean
    if name == "local_mean":
        near = ((idx >= a - context) & (idx < a)) | ((idx >= b) & (idx < b + context))
        return F.coalesce(F.avg(_where(near)).over(_all()), mean)
    if name == "linear":
        return F.coalesce(first + (last - first) * (idx - a + 1) / (b - a + 1).cast("double"), mean)
    if name == "gaussian":
        spread = F.stddev_pop("x").over(_all())
        spread = F.when(spread > 0, spread).otherwise(F.lit(1e-8))
        u, v = portable_random(F.lit(seed), F.col("series_id"), idx, F.lit("u")), portable_random(F.lit(seed), F.col("series_id"), idx, F.lit("v"))
        return mean + spread * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)
    if name == "noise100":
        return (portable_random(F.lit(seed), F.col("series_id"), idx, F.lit("n")) * 200 - 100) * sd + mu
    if name == "z_zero":
        return mu
    if name == "out_of_dist_high":
        return F.lit(100.0) * F.max(F.abs((x - mu) / sd)).over(_all()) * sd + mu
    if name == "inverse":
        return ((top - mu) / sd - (x - mu) / sd) * sd + mu
    raise ValueError(f"unknown masking operator {name!r}")


OPERATORS = ("identity", "zero", "global_mean", "local_mean", "linear", "gaussian", "noise100", "z_zero", "out_of_dist_high", "inverse")


def mask(points: DataFrame, name: str, *, context: int = 50, seed: int = 7) -> DataFrame:
    """``points`` with ``masked``. Operators of z-space standardise by the training part and map back.

    One window over each series; without context points a local mean falls back on the whole series' mean, and an edge
    of a linear fill on the neighbour there is.
    """
    return points.withColumn("masked", F.when(inside(), _value(name, context, seed)).otherwise(F.col("x")))


def mask_all(points: DataFrame, names: tuple[str, ...] = OPERATORS, **options: int) -> DataFrame:
    """Masked values of all operators, one row an operator: (series_id, idx, op, masked). One pass, not one a name."""
    wide = points
    for n in names:
        wide = mask(wide, n, **options).withColumnRenamed("masked", f"_{n}")
    return wide.select("series_id", "idx", F.explode(F.array(*[F.struct(F.lit(n).alias("op"), F.col(f"_{n}").alias("masked")) for n in names])).alias("v")).select("series_id", "idx", "v.op", "v.masked")


def shuffle_inside(points: DataFrame, *, seed: int = 7) -> DataFrame:
    """The region's values in a seeded random order: the same multiset, elsewhere unchanged."""
    w = Window.partitionBy("series_id", inside())
    numbered = points.withColumn("_k", F.row_number().over(w.orderBy("idx"))).withColumn("_r", F.row_number().over(w.orderBy(portable_random(F.lit(seed), F.col("series_id"), F.col("idx")), "idx")))
    moved = numbered.where(inside()).select("series_id", F.col("_r").alias("_k"), F.col("x").alias("_v"))
    out = numbered.join(moved, ["series_id", "_k"], "left")
    return out.withColumn("masked", F.when(inside(), F.col("_v")).otherwise(F.col("x"))).drop("_k", "_r", "_v")


def neighbour_window(points: DataFrame) -> DataFrame:
    """The region's r points from beside it: half from the left, the rest from the right; at an edge all from one side."""
    r = F.col("b") - F.col("a")
    half = F.ceil(r / 2)
    at = F.col("idx") - F.col("a")
    left_only, right_only = F.col("b") > F.col("n") - r, F.col("a") == 0
    source = F.when(right_only, F.col("b") + at).when(left_only, F.col("a") - r + at).when(at < half, F.col("a") - half + at).otherwise(F.col("b") + at - half)
    wanted = points.withColumn("_from", F.when(inside(), source))
    values = points.select("series_id", F.col("idx").alias("_from"), F.col("x").alias("_v"))
    return wanted.join(values, ["series_id", "_from"], "left").withColumn("masked", F.when(inside(), F.col("_v")).otherwise(F.col("x"))).drop("_from", "_v")


def donors(points: DataFrame, *, where: str = "test") -> DataFrame:
    """(series_id, u, d): the stretch whose surroundings are most like the region's, and its squared distance.

    Candidates lie in the test part, or in training; they keep clear of the labelled interval widened by w, of what the
    region reaches, and of its context of max(1, w div 4) points on either side. Equal distances go to the smaller u; a
    series without a candidate has no row. The search joins contexts on position within the series, and its cost is
    candidates times context.
    """
    s = points.select("series_id", "a", "b", "n", "te", "s0", "s1", "w").distinct().withColumn("c", F.greatest(F.lit(1).cast("long"), F.floor(F.col("w") / 4)))
    s = s.where("a >= c AND b + c <= n").withColumn("len", F.col("b") - F.col("a"))
    lo, hi = ("te", "n") if where == "test" else (None, "te")
    low = F.greatest(F.col(lo) if lo else F.lit(0).cast("long"), F.col("c"))
    high = F.least(F.col(hi), F.col("n") - F.col("c")) - F.col("len")
    s = s.withColumn("_lo", low).withColumn("_hi", high).where("_hi >= _lo").withColumn("u", F.explode(F.expr("sequence(_lo, _hi)")))
    for x, y in ((F.col("s0") - F.col("w"), F.col("s1") + F.col("w")), (F.col("a") - F.col("w") + 1, F.col("b") + F.col("w") - 1), (F.col("a") - F.col("c"), F.col("a")), (F.col("b"), F.col("b") + F.col("c"))):
        s = s.where(~((F.col("u") < y) & (F.col("u") + F.col("len") > x)))
    beside = s.withColumn("k", F.explode(F.expr("sequence(1L, 2 * c)")))
    left = F.col("k") <= F.col("c")
    beside = beside.withColumn("i", F.when(left, F.col("u") - F.col("k")).otherwise(F.col("u") + F.col("len") + F.col("k") - F.col("c") - 1)).withColumn("j", F.when(left, F.col("a") - F.col("k")).otherwise(F.col("b") + F.col("k") - F.col("c") - 1))
    at = points.select("series_id", "idx", "x")
    d = beside.join(at.select("series_id", F.col("idx").alias("i"), F.col("x").alias("xi")), ["series_id", "i"]).join(at.select("series_id", F.col("idx").alias("j"), F.col("x").alias("xj")), ["series_id", "j"])
    d = d.groupBy("series_id", "u").agg(F.round(F.sum((F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj"))), 9).alias("d"))
    return d.groupBy("series_id").agg(F.min_by("u", F.struct("d", "u")).alias("u"), F.min("d").alias("d"))


def reconstruct(points: DataFrame, *, where: str = "test") -> DataFrame:
    """The region's points copied from its donor; NULL where there is none."""
    wanted = points.join(donors(points, where=where).drop("d"), "series_id", "left").withColumn("_from", F.when(inside(), F.col("u") + F.col("idx") - F.col("a")))
    values = points.select("series_id", F.col("idx").alias("_from"), F.col("x").alias("_v"))
    return wanted.join(values, ["series_id", "_from"], "left").withColumn("masked", F.when(inside(), F.col("_v")).otherwise(F.col("x"))).drop("_from", "_v", "u")


def context_reconstruct(points: DataFrame) -> DataFrame:
    """(series_id, j): training window most like, z-normalised, the w points before the region; what follows it fills the region, levelled.

    w is each series' own. Series without w points before the region, or without a training window of w points and what
    follows it, have no rows.
    """
    packed = points.groupBy("series_id", "a", "b", "te", "n", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]).alias("xs"))
    starts = packed.where("a >= w").withColumn("j", F.explode(F.expr("sequence(0L, n - w)")))
    m = F.col("w").cast("int")
    wins = starts.select("series_id", "a", "b", "te", "n", "w", "j", F.expr("slice(xs, int(j) + 1, int(w))").alias("v")).withColumn("mu", F.aggregate("v", F.lit(0.0), lambda p, q: p + q) / m)
    wins = wins.withColumn("sd", F.sqrt(F.aggregate("v", F.lit(0.0), lambda p, q: p + (q - F.col("mu")) * (q - F.col("mu"))) / m)).withColumn("flat", F.array_max("v") == F.array_min("v"))
    z = F.transform("v", lambda q: F.when(F.col("flat"), F.lit(0.0)).otherwise((q - F.col("mu")) / F.col("sd")))
    wins = wins.select("series_id", "j", z.alias("z"), "flat", "a", "b", "te", "n", "w")
    query = wins.where(F.col("j") == F.col("a") - F.col("w")).select("series_id", F.col("z").alias("zq"), F.col("flat").alias("fq"))
    ref = wins.where((F.col("j") + F.col("w") + F.col("b") - F.col("a") <= F.col("te")))
    d = ref.join(query, "series_id").withColumn("d", F.when(F.col("flat") & F.col("fq"), 0.0).when(F.col("flat") | F.col("fq"), m.cast("double")).otherwise(F.aggregate(F.zip_with("z", "zq", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda p, q: p + q)))
    best = d.groupBy("series_id").agg(F.min_by("j", F.struct(F.round("d", 9), "j")).alias("j"))
    w = F.col("w")
    wanted = points.join(best, "series_id").withColumn("_from", F.when(inside(), F.col("j") + w + F.col("idx") - F.col("a")))
    values = points.select("series_id", F.col("idx").alias("_from"), F.col("x").alias("_v"))
    level = points.where(F.col("idx") == F.col("a") - 1).select("series_id", F.col("x").alias("_end"))
    there = points.select("series_id", (F.col("idx") - w + 1).alias("j"), F.col("x").alias("_there"))
    out = wanted.join(values, ["series_id", "_from"], "left").join(level, "series_id").join(there, ["series_id", "j"])
    return out.withColumn("masked", F.when(inside(), F.col("_v") + F.col("_end") - F.col("_there")).otherwise(F.col("x"))).drop("_from", "_v", "_end", "_there", "j")
