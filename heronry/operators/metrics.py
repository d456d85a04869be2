"""Faithfulness, artifact, attribution and localisation metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import average_rank, composite, ratio
from heronry.shared import dealt


# --- curves


def dds(morf: Column, lerf: Column, scale: Column) -> Column:
    """Weighted mean of lerf - morf over steps with weights ((n - i) / n)^3, normalised by ``scale`` times the weights after the first.

    NULL where the curves differ in length, have fewer than two points, or the scale isn't positive.
    """
    n = F.size(morf)
    w = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pow((n - i) / n.cast("double"), F.lit(3.0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda p, q: p + q)
    num = total(F.zip_with(F.zip_with(lerf, morf, lambda p, q: p - q), w, lambda p, q: p * q)) / total(w)
    den = scale * (total(w) - F.lit(1.0)) / total(w)
    return F.when((F.size(lerf) == n) & (n >= 2) & (scale > 0), num / den)


def curve(order: DataFrame, steps: int = 10) -> DataFrame:
    """(series_id, step, seg): the segments masked at each step, the first ceil(step * K / steps) of the order ``rn`` of K."""
    k = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return order.withColumn("_k", k).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).where(F.col("rn") <= F.ceil(F.col("step") * F.col("_k") / F.lit(steps))).select("series_id", "step", "seg")


def order_segments(attr: DataFrame, *, key: str = "signed") -> DataFrame:
    """``rn``: most relevant first, by value descending and then the tie rank; ``rn_least`` is its exact reverse."""
    v = F.abs("value") if key == "abs" else F.col("value")
    w = Window.partitionBy("series_id")
    return attr.withColumn("rn", F.row_number().over(w.orderBy(v.desc(), F.col("tie"), F.col("seg")))).withColumn("rn_least", F.count(F.lit(1)).over(w) + 1 - F.col("rn"))


# --- summaries


def positive_excess(x: Column) -> Column:
    """Share above zero less share below, NULLs left out."""
    return F.avg(F.signum(x))


def cell_summary(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each cell: n, mean, positive, negative and zero counts, PES, quartiles, their range, CMI."""
    x = F.col(value)
    out = facts.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.count_if(x > 0).alias("pos"), F.count_if(x < 0).alias("neg"), F.count_if(x == 0).alias("zero"), positive_excess(x).alias("pes"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    out = out.select(*keys, "n", "mean", "pos", "neg", "zero", "pes", *[F.get("q", i).alias(c) for i, c in enumerate(("q25", "q50", "q75"))])
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("cmi", composite(F.col("mean"), F.col("pes")))


def sar_table(ai: DataFrame, *, least: int = 5) -> DataFrame:
    """Per (series_id, op) from rows (series_id, op, region, ai): anomaly effect over the median size of normal effects.

    Rows without a donor have a NULL ai. The denominator is zero below 1e-6, a pair with fewer than ``least`` normal
    positions is excluded, and ratios are NULL unless all is well.
    """
    normal = F.when(F.col("region") == "sar_normal", F.abs("ai"))
    out = ai.groupBy("series_id", "op").agg(F.max(F.when(F.col("region") == "anomaly", F.col("ai"))).alias("ai_anom"), F.median(normal).alias("den"), F.count(normal).alias("n_pos"))
    out = out.withColumn("den_zero", F.coalesce(F.col("den") < 1e-6, F.lit(False))).withColumn("excluded", F.col("n_pos") < least).withColumn("reversal", F.col("ai_anom") > 0).withColumn("removal", F.greatest(F.lit(0.0), -F.col("ai_anom")))
    ok = ~F.col("den_zero") & ~F.col("excluded") & F.col("ai_anom").isNotNull()
    return out.withColumn("sar", F.when(ok, F.col("removal") / F.col("den"))).withColumn("sar_abs", F.when(ok, F.abs("ai_anom") / F.col("den")))


def false_alarms(positions: DataFrame, keys: list[str], *, least: int = 10) -> DataFrame:
    """Per cell of rows (before, after, thr): alarms before, new alarms, and their rate among the rest if that has ``least``."""
    pre, fa = F.col("before") > F.col("thr"), (F.col("before") <= F.col("thr")) & (F.col("after") > F.col("thr"))
    out = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(pre).alias("pre"), F.count_if(fa).alias("fa")).withColumn("remaining", F.col("n") - F.col("pre"))
    return out.withColumn("rate", F.when(F.col("remaining") >= least, ratio(F.col("fa"), F.col("remaining"))))


def artifact_index(shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Median standardised shift and the share of responses above the threshold, from rows (before, after, sd, thr)."""
    return shifts.groupBy(*keys).agg(F.median(ratio(F.col("after") - F.col("before"), F.col("sd"))).alias("ai"), F.avg((F.col("after") > F.col("thr")).cast("double")).alias("violation_rate"))


# --- localisation


def localization(points: DataFrame, *, tolerance: int = 100) -> DataFrame:
    """Per series from rows (idx, r, y): mass on the label, its lift over the label's share, and mass near the label.

    Without any mass all points count alike.
    """
    w = Window.partitionBy("series_id")
    r = F.when(F.sum("r").over(w) > 0, F.col("r")).otherwise(F.lit(1.0))
    at = F.when(F.col("y") == 1, F.col("idx"))
    p = points.withColumn("_r", r).withColumn("_lo", F.min(at).over(w) - tolerance).withColumn("_hi", F.max(at).over(w) + 1 + tolerance)
    out = p.groupBy("series_id").agg(F.sum("_r").alias("all"), F.sum(F.when(F.col("y") == 1, F.col("_r")).otherwise(0.0)).alias("on"), F.avg(F.col("y").cast("double")).alias("share"), F.sum(F.when((F.col("idx") >= F.col("_lo")) & (F.col("idx") < F.col("_hi")), F.col("_r")).otherwise(0.0)).alias("near"))
    return out.select("series_id", (F.col("on") / F.col("all")).alias("lp"), ratio(F.col("on") / F.col("all"), F.col("share")).alias("lift"), (F.col("near") / F.col("all")).alias("lp_tolerant"), F.col("share").alias("chance"))


def auroc(points: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Per series the rank-sum AUROC and the average precision; NULL with one class only."""
    rank = average_rank(F.col(score), ["series_id"], descending=False)
    desc = Window.partitionBy("series_id").orderBy(F.col(score).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    p = points.withColumn("_rank", rank).withColumn("_tp", F.sum(label).over(desc)).withColumn("_n", F.count(F.lit(1)).over(desc))
    out = p.groupBy("series_id").agg(F.sum(F.when(F.col(label) == 1, F.col("_rank"))).alias("rs"), F.sum(label).cast("double").alias("np"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col(label) == 1, F.col("_tp") / F.col("_n").cast("double"))).alias("ap"))
    nn = F.col("n") - F.col("np")
    both = (F.col("np") > 0) & (nn > 0)
    return out.select("series_id", F.when(both, (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * nn)).alias("auroc"), F.when(both, F.col("ap") / F.col("np")).alias("ap"))


def plausibility(points: DataFrame, *, key: str = "relu") -> DataFrame:
    """Per series from rows (idx, v, y, tie): mass in the label (RMA), share of the top points in it (RRA), and both between chance and 1."""
    v = F.greatest(F.col("v"), F.lit(0.0)) if key == "relu" else F.abs("v")
    w = Window.partitionBy("series_id")
    p = points.withColumn("_v", v).withColumn("_gt", F.sum("y").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col("_v").desc(), F.col("tie"), F.col("idx"))))
    out = p.groupBy("series_id").agg(F.sum("_v").alias("mass"), F.sum(F.col("_v") * F.col("y")).alias("on"), F.sum(F.when(F.col("_rn") <= F.col("_gt"), F.col("y"))).alias("top"), F.max("_gt").alias("gt"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v") < 0, -F.col("v")).otherwise(0.0)).alias("neg"), F.sum(F.abs("v")).alias("all"))
    chance = ratio(F.col("gt"), F.col("n"))
    rma, rra = F.when(F.col("mass") > 0, F.col("on") / F.col("mass")), ratio(F.col("top"), F.col("gt"))
    between = lambda x: F.when(F.lit(1.0) - chance >= 1e-6, (x - chance) / (F.lit(1.0) - chance))
    return out.select("series_id", rma.alias("rma"), rra.alias("rra"), chance.alias("chance"), between(rma).alias("rma_norm"), between(rra).alias("rra_norm"), ratio(F.col("neg"), F.col("all")).alias("neg_mass"))


# --- baselines and attributions


def baselines(points: DataFrame, *, width: int = 5, seed: int = 7) -> DataFrame:
    """Scores that sum to 1 in each series: random, uniform, |z|, and squared residual to a zero-padded moving average."""
    from heronry.functions.numeric import portable_random

    w = Window.partitionBy("series_id")
    half = width // 2
    ma = F.sum("x").over(w.orderBy("idx").rowsBetween(-half, width - 1 - half)) / width
    sd = F.stddev_pop("x").over(w)
    raw = {"random": portable_random(F.lit(seed), F.col("series_id"), F.col("idx")), "uniform": F.lit(1.0), "abs_z": F.abs((F.col("x") - F.avg("x").over(w)) / F.nullif(sd, F.lit(0.0))), "residual": (F.col("x") - ma) * (F.col("x") - ma)}
    out = points
    for k, v in raw.items():
        out = out.withColumn(k, v)
    n = F.count(F.lit(1)).over(w)
    return out.select("series_id", "idx", *[F.coalesce(F.col(k) / F.nullif(F.sum(k).over(w), F.lit(0.0)), F.lit(1.0) / n).alias(k) for k in raw])


def ablation(f0: DataFrame, masked: DataFrame) -> DataFrame:
    """f(whole) - f(one segment masked): rows (series_id, seg, value)."""
    return masked.join(f0, "series_id").select("series_id", "seg", (F.col("f0") - F.col("f")).alias("value"))


def spread_to_points(attr: DataFrame, segs: DataFrame) -> DataFrame:
    """Segment values over their points, in equal parts: (series_id, idx, v)."""
    return attr.join(segs, ["series_id", "seg"]).select("series_id", F.explode(F.expr("sequence(a, b - 1)")).alias("idx"), (F.col("value") / (F.col("b") - F.col("a"))).alias("v"))


def kernel_shap(evaluated: DataFrame) -> DataFrame:
    """Shapley values by weighted least squares, from rows (series_id, z: array of 0/1, weight, f): (series_id, seg, value).

    A series has at most 64 unknowns and a bounded number of draws, so its rows are packed into one and many series are
    solved in a batch; the evaluation of coalitions before it is plain joins.
    """
    packed = evaluated.groupBy("series_id").agg(F.collect_list(F.struct("z", "weight", "f")).alias("r")).select("series_id", F.size(F.get("r", 0)["z"]).alias("k"), F.flatten(F.transform("r", lambda x: x["z"])).alias("z"), F.transform("r", lambda x: x["weight"]).alias("weight"), F.transform("r", lambda x: x["f"]).alias("f"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples():
                z, w = np.asarray(r.z, float).reshape(-1, r.k), np.sqrt(np.asarray(r.weight, float))
                a = np.column_stack((np.ones(len(z)), z)) * w[:, None]
                beta = np.linalg.lstsq(a, np.asarray(r.f, float) * w, rcond=None)[0][1:]
                found.append((r.series_id, beta))
            if found:
                size = [len(v) for _, v in found]
                yield pd.DataFrame({"series_id": np.repeat([i for i, _ in found], size), "seg": np.concatenate([np.arange(n) for n in size]), "value": np.concatenate([v for _, v in found])})

    kind = evaluated.schema["series_id"].dataType.simpleString()
    return packed.mapInPandas(solve, f"series_id {kind}, seg long, value double")


def merged(sets: DataFrame) -> DataFrame:
    """(series_id, z, weight): equal sets of a series as one, with their weights added; the least squares are the same."""
    return sets.groupBy("series_id", "z").agg(F.sum("weight").alias("weight"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit keys, by shifts and products (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(key: int, k: int, first: int, last: int) -> np.ndarray:
    """(draws, k) of 0 and 1: draws first to last of a series, each by hashes of the series' key and its number alone."""
    size = np.arange(1, k)
    p = np.cumsum((k - 1) / (size * (k - size)))
    own = _mixed(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + np.arange(first, last, dtype=np.uint64))
    count = np.minimum(np.searchsorted(p, (own >> np.uint64(11)) * 2.0**-53 * p[-1], side="right"), k - 2)
    order = _mixed(own[:, None] ^ (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32)))
    return (order <= np.take_along_axis(np.sort(order, axis=1), count[:, None], axis=1)).astype(np.int32)


def coalitions(sized: DataFrame, draws: Column | int, *, seed: int = 7) -> DataFrame:
    """(series_id, d, z, weight) from rows (series_id, k): all and none with weight 1e6, then draws of size j with p ~ (k - 1) / (j (k - j))."""
    ends = sized.withColumn("e", F.explode(F.array(F.lit(1), F.lit(0)))).select("series_id", (-F.col("e") - 1).cast("long").alias("d"), F.array_repeat("e", F.col("k").cast("int")).alias("z"), F.lit(1e6).alias("weight"))
    # draws are dealt out in blocks: a series has thousands, and their work is large for their bytes
    blocks = sized.where("k > 1").select("series_id", F.col("k").cast("long").alias("k"), F.xxhash64(F.lit(seed), "series_id").alias("key"), F.lit(draws).cast("long").alias("m"))
    blocks = dealt(blocks.withColumn("b", F.explode(F.expr("sequence(0L, m - 1, 4096L)"))), "series_id", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (k, key, m, b) in enumerate(zip(*(batch[c].to_pylist() for c in ("k", "key", "m", "b")), strict=True)):
                z = _draws(key, k, b, min(b + 4096, m))
                values = pa.ListArray.from_arrays(np.arange(0, z.size + 1, k, dtype=np.int32), z.ravel())
                yield pa.RecordBatch.from_arrays([batch["series_id"].take(pa.array(np.full(len(z), i))), pa.array(np.arange(b, b + len(z))), values, pa.array(np.ones(len(z)))], ["series_id", "d", "z", "weight"])

    drawn = blocks.mapInArrow(run, f"series_id {sized.schema['series_id'].dataType.simpleString()}, d long, z array<int>, weight double")
    return ends.unionByName(drawn)
