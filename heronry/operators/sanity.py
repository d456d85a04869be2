"""What has to hold of a profile when a region is masked: checks that stop a run which breaks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators import masking as M
from heronry.operators import profile as P
from heronry.operators.checks import mismatch_rate
from heronry.shared import written

#: Masking operators that fill a region with one value.
CONSTANT = ("zero", "global_mean", "local_mean", "z_zero", "out_of_dist_high")


def _masked(points: DataFrame, op: str) -> DataFrame:
    if op in ("recon_test", "recon_train"):
        return M.reconstruct(points, where=op.removeprefix("recon_"))
    return M.mask(points, op)


def reactions(series: DataFrame, regions: DataFrame, ops: Sequence[str], *, kind: str = "z", whole: bool = False) -> DataFrame:
    """(series_id, op, start, base, after, whole) of every window: its distance before, after [a, b) is masked by each
    operator (only windows that meet it computed anew), and with ``whole`` from a profile computed anew altogether.

    A series whose region has no donor under an operator has no rows of it.
    """
    points = series.join(regions, "series_id")
    base = written(P.matrix_profile(series, regions, kind=kind), "base-profile")
    out = None
    for op in ops:
        filled = _masked(points, op)
        lacking = filled.where("masked IS NULL").select("series_id").distinct()
        there = regions.join(lacking, "series_id", "left_anti")
        changed = written(filled.join(there.select("series_id"), "series_id", "left_semi").select("series_id", "idx", F.col("masked").alias("x")), "masked-series")
        kept = base.join(there.select("series_id"), "series_id", "left_semi")
        after = P.incremental(kept, series.join(there.select("series_id"), "series_id", "left_semi"), changed, there, kind=kind)
        part = kept.select("series_id", "start", F.col("dist").alias("base")).join(after.select("series_id", "start", F.col("dist").alias("after")), ["series_id", "start"])
        if whole:
            part = part.join(P.matrix_profile(changed, there, kind=kind).select("series_id", "start", F.col("dist").alias("whole")), ["series_id", "start"])
        part = part.withColumn("op", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


def flat_windows(series: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, flats): constant windows of each training part."""
    from pyspark.sql import Window

    known = series.join(layouts.select("series_id", "te", "w"), "series_id").where("idx < te")
    # a window is constant where the run of equal values that ends it is as long as it
    order = Window.partitionBy("series_id").orderBy("idx")
    new = F.coalesce((F.col("x") != F.lag("x").over(order)).cast("int"), F.lit(1))
    runs = known.withColumn("_run", F.sum(new).over(order)).groupBy("series_id", "_run").agg(F.count(F.lit(1)).alias("n"), F.first("w").alias("w"))
    return runs.groupBy("series_id").agg(F.sum(F.greatest(F.col("n") - F.col("w") + 1, F.lit(0))).cast("long").alias("flats"))


def fill_checks(series: DataFrame, regions: DataFrame, *, ops: Sequence[str] = CONSTANT, within: float = 1e-12, copied: float = 1e-3) -> DataFrame:
    """(check, op, cases, match_rate, mismatches, stop) of regions as long as a window.

    Filled with one value, the region is a constant window: without a constant one in training it is sqrt(w) from all
    ("root"), and the largest distance in the region is that or more ("response"); with one it is 0 ("flat"). Filled from
    a training donor, it is a training window, and 0 within ``copied`` ("copy"). A region of another length is an error.
    """
    exact = F.when(F.col("b") - F.col("a") == F.col("w"), F.col("a")).otherwise(F.raise_error(F.lit("a region isn't as long as a window")).cast("long"))
    regions = regions.withColumn("a", exact)
    half = F.floor(F.col("w") / 2)
    r = reactions(series, regions, [*ops, "recon_train"]).join(regions.select("series_id", "a", "b", "w"), "series_id").join(flat_windows(series, regions), "series_id")
    per = r.groupBy("series_id", "op", "flats", "w").agg(F.max(F.when(F.col("start") == F.col("a"), F.col("after"))).alias("there"), F.max(F.when((F.col("start") + half >= F.col("a")) & (F.col("start") + half < F.col("b")), F.col("after"))).alias("response"))
    root, filled = F.sqrt(F.col("w").cast("double")), F.col("op") != "recon_train"
    checks = F.array(
        F.struct(F.lit("root").alias("check"), filled & (F.col("flats") == 0), F.abs(F.col("there") - root) <= within),
        F.struct(F.lit("response").alias("check"), filled & (F.col("flats") == 0), F.col("response") >= root - within),
        F.struct(F.lit("flat").alias("check"), filled & (F.col("flats") > 0), F.abs("there") <= within),
        F.struct(F.lit("copy").alias("check"), ~filled, F.col("there") <= copied),
    )
    each = per.select("op", F.explode(F.transform(checks, lambda c: F.struct(c["check"].alias("check"), c["col2"].alias("applies"), c["col3"].alias("ok")))).alias("c")).select("op", "c.*").where("applies")
    return mismatch_rate(each, ["check", "op"], F.col("ok"))


def profile_assertions(series: DataFrame, regions: DataFrame, *, within: float = 1e-8) -> DataFrame:
    """(rule, cases, failed, passes), over regions of a window or more.

    untouched: windows that don't meet the region keep their distance when all are computed anew. incremental: computing
    only those that meet it gives the same. one_value: windows inside a constant fill have one distance, whatever the
    value, when windows are normalised. told_apart: of plain windows the far fill gives others than zero and the mean.
    same_mean: zero of the standardised series is the training mean.
    """
    ops = ["zero", "global_mean", "z_zero", "out_of_dist_high"]
    long = regions.where(F.col("b") - F.col("a") >= F.col("w"))
    span = long.select("series_id", "a", "b", "w")
    inside = (F.col("start") >= F.col("a")) & (F.col("start") + F.col("w") <= F.col("b"))
    sets = {kind: written(reactions(series, long, ops, kind=kind, whole=True).join(span, "series_id"), "reactions") for kind in ("z", "raw")}
    both = sets["z"].unionByName(sets["raw"])
    per = both.groupBy("series_id").agg(
        F.max(F.when(~P.touched(F.col("a"), F.col("b")), F.abs(F.col("whole") - F.col("base")))).alias("u"),
        F.max(F.abs(F.col("after") - F.col("whole"))).alias("i"),
    )
    values = sets["z"].where(inside).groupBy("series_id").agg(F.countDistinct("after").alias("n"))
    raw = sets["raw"].where(inside).groupBy("series_id", "start").agg(*[F.max(F.when(F.col("op") == o, F.col("after"))).alias(o) for o in ops])
    apart = raw.groupBy("series_id").agg((F.max(F.abs(F.col("zero") - F.col("out_of_dist_high"))) > 0).alias("p"), (F.max(F.abs(F.col("global_mean") - F.col("out_of_dist_high"))) > 0).alias("q"))
    points = series.join(long, "series_id")
    fill = M.mask(points, "z_zero").where(M.inside()).groupBy("series_id").agg(F.max("masked").alias("fill"))
    mean = points.where("idx < te").groupBy("series_id").agg(F.avg("x").alias("mean"))
    known = per.join(values, "series_id", "left").join(apart, "series_id", "left").join(fill, "series_id", "left").join(mean, "series_id", "left")
    rules = {
        "untouched": F.coalesce(F.col("u") <= within, F.lit(True)),
        "incremental": F.col("i") <= within,
        "one_value": F.col("n") == 1,
        "told_apart": F.col("p") & F.col("q"),
        "same_mean": F.abs(F.col("fill") - F.col("mean")) <= within,
    }
    counts = known.agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules])).alias("r")
    return counts.select("cases", each).select("r.rule", "cases", "r.failed", (F.col("r.failed") == 0).alias("passes"))
