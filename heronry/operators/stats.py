"""Grouped statistics: rank agreement, tests, intervals, resampling, allocation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import average_rank, portable_random
from heronry.operators.tables import ranked


def spearman_pairs(values: DataFrame, *, rater: str = "rater", item: str = "item", value: str = "value") -> DataFrame:
    """(rater_a, rater_b, rho, n) of all pairs a < b over the items both rate; NULL where one is constant."""
    a = values.select(F.col(rater).alias("rater_a"), item, F.col(value).alias("va"))
    b = values.select(F.col(rater).alias("rater_b"), item, F.col(value).alias("vb"))
    both = a.join(b, item).where("rater_a < rater_b")
    keys = ["rater_a", "rater_b"]
    ranked = both.withColumn("ra", average_rank(F.col("va"), keys)).withColumn("rb", average_rank(F.col("vb"), keys))
    ok = (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return ranked.groupBy(*keys).agg(F.when(ok, F.corr("ra", "rb")).alias("rho"), F.count(F.lit(1)).alias("n"))


def kendall_w(ranks: DataFrame, keys: list[str], *, rater: str = "rater", item: str = "item", rank: str = "rank") -> DataFrame:
    """Kendall's W without tie correction: 12 S / (m^2 (n^3 - n)); NULL for fewer than two items."""
    sums = ranks.groupBy(*keys, item).agg(F.sum(rank).alias("r"), F.countDistinct(rater).alias("m"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    dev = sums.withColumn("d", F.col("r") - F.avg("r").over(w))
    out = dev.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.max("m").cast("double").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    return out.select(*keys, (F.lit(12.0) * F.col("s") / F.nullif(F.col("m") * F.col("m") * (F.col("n") * F.col("n") * F.col("n") - F.col("n")), F.lit(0.0))).alias("w"), "m", "n")


def kendall_tau(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", item: str = "item") -> DataFrame:
    """tau-b from rows (keys, item, x, y): signs over all pairs of items of a key; meant for short rankings."""
    a, b = pairs.alias("a"), pairs.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{item}") < F.col(f"b.{item}")]
    sx, sy = (F.signum(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in (x, y))
    out = a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.sum(sx * sy).alias("c"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return out.select(*keys, (F.col("c") / F.nullif(F.sqrt(F.col("nx") * F.col("ny")), F.lit(0.0))).alias("tau"))


def holm(tests: DataFrame, keys: list[str], p: str = "p", order: str = "test") -> DataFrame:
    """``p_holm``: step-down adjustment within ``keys``; the running maximum of (k - i) p, 1 at most."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    i = F.row_number().over(w.orderBy(p, order))
    raw = tests.withColumn("_a", (F.count(F.lit(1)).over(w) - i + 1) * F.col(p)).withColumn("_i", i)
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("_a").over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))).drop("_a", "_i")


def wilcoxon(diffs: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """Signed-rank test: (n, w_plus, w_minus, p); zeros left out, normal approximation with tie correction; p 1 if nothing is left."""
    nz = diffs.where(F.col(d) != 0).withColumn("_abs", F.round(F.abs(d), 12))
    ranked = nz.withColumn("_r", average_rank(F.col("_abs"), keys, descending=False)).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_abs")))
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(d) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties"))
    var = F.col("n") * (F.col("n") + 1) * (F.col("n") * 2 + 1) / 24 - F.col("ties") / 48
    z = (F.least("w_plus", "w_minus") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(var)
    out = sums.withColumn("p", F.least(F.lit(1.0), F.lit(2.0) * normal_cdf(z)))
    all_ = diffs.select(*keys).distinct()
    return all_.join(out.drop("ties"), keys, "left").fillna({"n": 0.0, "w_plus": 0.0, "w_minus": 0.0, "p": 1.0})


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function to 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    # fixed values of the published approximation
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + F.lit(c)) * t
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, tail).otherwise(F.lit(1.0) - tail)


# --- resampling


def draws(spark, units: DataFrame, replicates: int, *, seed: int = 7, unit: str = "unit") -> DataFrame:
    """(b, unit): for each replicate as many draws with replacement as there are units.

    One index stream for everything that is resampled: join facts to it once. A unit's place is its rank by id.
    """
    numbered = ranked(units.select(unit).distinct(), [unit], "_k")
    n = numbered.count()
    if not n:
        return units.select(F.lit(0).cast("long").alias("b"), unit).limit(0)
    picks = spark.range(replicates * n).select((F.col("id") / n).cast("long").alias("b"), F.pmod(F.col("id"), F.lit(n)).alias("_d"))
    picks = picks.withColumn("_k", F.floor(portable_random(F.lit(seed), F.col("b"), F.col("_d")) * n).cast("long"))
    return picks.join(numbered, "_k").select("b", unit)


def bootstrap(facts: DataFrame, drawn: DataFrame, keys: list[str], stat: Column, *, unit: str = "unit") -> DataFrame:
    """(keys, lo, hi, n_rep): 2.5th and 97.5th percentile over replicates of ``stat``, an aggregate over drawn facts."""
    reps = drawn.join(facts, unit).groupBy("b", *keys).agg(stat.alias("_s"))
    return reps.groupBy(*keys).agg(F.percentile("_s", F.lit(0.025)).alias("lo"), F.percentile("_s", F.lit(0.975)).alias("hi"), F.count("_s").alias("n_rep"))


def allocate(strata: DataFrame, total: int, *, stratum: str = "stratum", count: str = "n") -> DataFrame:
    """``seats``: proportional, at least 1; what is left goes by largest remainder, then larger count, then name, to strata not raised."""
    w = Window.partitionBy(F.lit(1))
    q = F.lit(float(total)) * F.col(count) / F.sum(count).over(w)
    base = strata.withColumn("_q", q).withColumn("_f", F.floor("_q")).withColumn("_raised", F.col("_f") == 0).withColumn("_s", F.greatest(F.col("_f"), F.lit(1)))
    base = base.withColumn("_left", F.lit(total) - F.sum("_s").over(w)).withColumn("_open", ~F.col("_raised") & (F.col("_s") < F.col(count)))
    order = F.row_number().over(Window.partitionBy("_open").orderBy((F.col("_q") - F.col("_f")).desc(), F.col(count).desc(), stratum))
    return base.withColumn("seats", (F.col("_s") + F.when(F.col("_open") & (order <= F.col("_left")), 1).otherwise(0)).cast("long")).drop("_q", "_f", "_raised", "_s", "_left", "_open")


def pick(rows: DataFrame, group: str, size: Column | int, *, key: str, seed: int = 7) -> DataFrame:
    """``size`` random rows of each group, by seeded hash; the same rows on any cluster."""
    w = Window.partitionBy(group).orderBy(portable_random(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def disjoint(candidates: DataFrame, want: int, *, seed: int = 7) -> DataFrame:
    """(series_id, a): up to ``want`` starts of regions of ``len`` points that don't overlap, in seeded random order.

    Takes the first of the order, skips what overlaps those taken: a fold over each series' sorted candidates.
    """
    order = F.array_sort(F.collect_list(F.struct(portable_random(F.lit(seed), F.col("series_id"), F.col("a")).alias("r"), "a", "len")))
    packed = candidates.groupBy("series_id").agg(order.alias("c"))
    empty = F.array().cast("array<struct<a:bigint,len:bigint>>")
    take = lambda done, x: F.when((F.size(done) < want) & ~F.exists(done, lambda y: (x["a"] < y["a"] + y["len"]) & (y["a"] < x["a"] + x["len"])), F.concat(done, F.array(F.struct(x["a"].cast("long").alias("a"), x["len"].cast("long").alias("len"))))).otherwise(done)
    return packed.select("series_id", F.explode(F.aggregate("c", empty, take)).alias("r")).select("series_id", "r.a", "r.len")


def makespan(jobs: DataFrame, workers: int, *, cost: str = "cost") -> DataFrame:
    """One row: load of the busiest of ``workers`` when jobs go, longest first, to the least loaded; for job lists of a plan."""
    packed = jobs.agg(F.sort_array(F.collect_list(F.col(cost).cast("double")), asc=False).alias("c"))
    start = F.array_repeat(F.lit(0.0), workers)
    fold = F.aggregate("c", start, lambda load, c: F.concat(F.slice(F.array_sort(load), 2, workers), F.array(F.array_min(load) + c)))
    return packed.select(F.array_max(fold).alias("makespan"))


def nnls3(facts: DataFrame, x: tuple[str, str, str], y: str) -> tuple[float, float, float]:
    """Non-negative least squares in three variables: normal equations in SQL, the best of the eight active sets here."""
    from itertools import combinations

    import numpy as np

    aggs = [F.sum(F.col(a) * F.col(b)) for a in x for b in x] + [F.sum(F.col(a) * F.col(y)) for a in x] + [F.sum(F.col(y) * F.col(y))]
    v = np.array([float(t or 0) for t in facts.agg(*aggs).first()])
    g, c, best = v[:9].reshape(3, 3), v[9:12], (v[12], (0.0, 0.0, 0.0))
    for n in (1, 2, 3):
        for s in combinations(range(3), n):
            w = np.zeros(3)
            w[list(s)] = np.linalg.lstsq(g[np.ix_(s, s)], c[list(s)], rcond=None)[0]
            loss = v[12] - 2 * w @ c + w @ g @ w
            if (w >= 0).all() and loss < best[0] - 1e-12:
                best = (loss, tuple(w.tolist()))
    return best[1]
