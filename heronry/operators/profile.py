"""Nearest-neighbour window joins (matrix profile).

The distance of a window is the least Euclidean distance to any window of the reference, of z-normalised windows (kind
"z") or of plain ones (kind "raw"). Under "z" two constant windows are 0 apart, and one constant window is sqrt(m) away
from any other; a window is constant when its largest value equals its smallest.

Series are packed and dealt out in pairs of a block of query windows and a block of reference windows, each with its own
two slices only: one long series spreads over as many tasks as it has pairs, and a task never holds a whole series. The
least over the reference blocks is a grouped minimum. Within a pair one matrix product finds the candidates of each
window; their distances are then sums of squared differences, so that exact matches are exactly 0 and ties are true ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.operators.series import pack
from heronry.shared import dealt

#: Windows of a block.
BLOCK = 2048


def normalised(v: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows) as the kind compares them, and which are constant under "z"."""
    if kind == "raw":
        return v, np.zeros(len(v), bool)
    constant = v.max(axis=1) == v.min(axis=1) if len(v) else np.zeros(0, bool)
    sd = v.std(axis=1)
    sd = np.where(constant | (sd == 0), 1.0, sd)
    return np.where(constant[:, None], 0.0, (v - v.mean(axis=1)[:, None]) / sd[:, None]), constant


def _windows(x: np.ndarray, m: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return normalised(np.lib.stride_tricks.sliding_window_view(x, m) if len(x) >= m else np.zeros((0, m)), kind)


def nearest(query: np.ndarray, reference: np.ndarray, m: int, *, kind: str = "z", first: int = 0, first_ref: int = 0, exclusion: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each window of ``query`` to its nearest one in ``reference``, and where that one starts (the first of equals).

    ``first`` and ``first_ref`` are where the slices begin in their series. With ``exclusion`` e, windows whose starts are
    e or less apart are no neighbours. A window without a neighbour has an infinite distance.
    """
    a, ca = _windows(query, m, kind)
    b, cb = _windows(reference, m, kind)
    far = None
    if exclusion is not None:
        far = np.abs(np.arange(first, first + len(a))[:, None] - np.arange(first_ref, first_ref + len(b))[None]) <= exclusion
    dist, where = least(a, ca, b, cb, kind=kind, apart=far)
    return dist, np.where(where >= 0, where + first_ref, -1)


def least(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray, *, kind: str = "z", apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each window of ``a`` to its nearest in ``b``, and which that is; pairs marked in ``apart`` are none."""
    if not len(a) or not len(b):
        return np.full(len(a), np.inf), np.full(len(a), -1)
    m = a.shape[1]
    middle = b.mean() if kind == "raw" else 0.0  # products of smaller numbers lose less
    p, q = a - middle, b - middle
    size_a, size_b = (p * p).sum(axis=1), (q * q).sum(axis=1)
    d = size_a[:, None] + size_b[None] - 2 * (p @ q.T)
    slack = 1e-9 * (size_a + size_b.max())[:, None] + 1e-300
    if kind == "z":
        d[ca[:, None] != cb[None]] = m
        d[ca[:, None] & cb[None]] = 0.0
    if apart is not None:
        d[apart] = np.inf
    lowest = d.min(axis=1)
    rows, cols = np.nonzero((d <= lowest[:, None] + slack) & np.isfinite(d))
    exact = np.zeros(len(rows))
    for k in range(m):
        diff = a[rows, k] - b[cols, k]
        exact += diff * diff
    if kind == "z":
        exact[ca[rows] != cb[cols]] = m
        exact[ca[rows] & cb[cols]] = 0.0
    best, where = np.full(len(a), np.inf), np.full(len(a), -1)
    order = np.lexsort((cols, exact, rows))
    lead = order[np.append(True, rows[order][1:] != rows[order][:-1])[: len(order)]]
    best[rows[lead]], where[rows[lead]] = exact[lead], cols[lead]
    return np.sqrt(best), where


def matrix_profile(series: DataFrame, layouts: DataFrame, *, mode: str = "ab_join", kind: str = "z", starts: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(series_id, start, dist, nearest): windows of each series against the training part, or against itself.

    ``mode``: "ab_join" takes windows inside [0, te) as reference, "self_join" all but those ceil(w / 4) or less away.
    ``starts`` is a condition on ``start`` and layout columns; only blocks that hold such starts are computed.
    """
    if mode not in ("ab_join", "self_join") or kind not in ("z", "raw"):
        raise ValueError(f"unknown mode {mode!r} or kind {kind!r}")
    blocks = layouts.join(pack(series), "series_id").where(F.size("xs") >= F.col("w"))
    blocks = blocks.withColumn("start", F.explode(F.expr(f"sequence(0, size(xs) - int(w), {block})")))
    if starts is not None:
        wanted = blocks.select(*layouts.columns, F.col("start").alias("q0"), F.explode(F.expr(f"sequence(start, least(start + {block - 1}, size(xs) - int(w)))")).alias("start")).where(starts)
        wanted = wanted.groupBy("series_id", "q0").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
        blocks = blocks.withColumnRenamed("start", "q0").join(wanted, ["series_id", "q0"])
    else:
        blocks = blocks.withColumnRenamed("start", "q0").withColumn("lo", F.col("q0")).withColumn("hi", F.expr(f"least(q0 + {block - 1}, size(xs) - int(w))"))
    last = F.expr("int(te)") if mode == "ab_join" else F.size("xs")  # where the reference ends
    pairs = blocks.withColumn("ref_end", last).where(F.col("ref_end") >= F.col("w")).withColumn("r0", F.explode(F.expr(f"sequence(0, ref_end - int(w), {block})")))
    m = F.col("w").cast("int")
    narrow = pairs.select("series_id", "w", "lo", "r0", F.slice("xs", F.col("lo") + 1, F.col("hi") - F.col("lo") + m).alias("q"), F.slice("xs", F.col("r0") + 1, F.least(F.lit(block) + m - 1, F.col("ref_end") - F.col("r0"))).alias("ref"))

    out = against(narrow, kind=kind, id_type=series.schema["series_id"].dataType.simpleString(), self_join=mode == "self_join")
    return out.join(layouts, "series_id").where(starts).select(*out.columns) if starts is not None else out


def against(pairs: DataFrame, *, kind: str, id_type: str, self_join: bool = False) -> DataFrame:
    """(series_id, start, dist, nearest) from pairs of blocks (series_id, w, lo, q, r0, ref), each pair dealt out by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                m = int(r.w)
                d, j = nearest(np.asarray(r.q, float), np.asarray(r.ref, float), m, kind=kind, first=int(r.lo), first_ref=int(r.r0), exclusion=-(-m // 4) if self_join else None)
                out.append((np.full(len(d), r.series_id), np.arange(r.lo, r.lo + len(d)), d, j))
            if out:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(("series_id", "start", "dist", "nearest"), zip(*out, strict=True), strict=True)})

    each = dealt(pairs.select("series_id", "w", "lo", "r0", "q", "ref"), "series_id", "lo", "r0")
    out = each.mapInPandas(run, f"series_id {id_type}, start long, dist double, nearest long").where(F.col("dist") < float("inf"))
    return out.groupBy("series_id", "start").agg(F.min(F.struct("dist", "nearest")).alias("m")).select("series_id", "start", "m.dist", "m.nearest")


def pad(profile: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, idx, score): a window's value at its middle, the profile's smallest value at points without one."""
    least = profile.groupBy("series_id").agg(F.min("dist").alias("least"))
    points = layouts.join(least, "series_id").select("series_id", "w", "least", F.explode(F.expr("sequence(0L, n - 1)")).alias("idx"))
    moved = profile.join(layouts.select("series_id", "w"), "series_id").select("series_id", (F.col("start") + F.floor(F.col("w") / 2)).alias("idx"), "dist")
    return points.join(moved, ["series_id", "idx"], "left").select("series_id", "idx", F.coalesce("dist", "least").alias("score"))


def touched(a: Column, b: Column) -> Column:
    """Whether the window at ``start`` meets [a, b)."""
    return (F.col("start") > a - F.col("w")) & (F.col("start") < b)


def incremental(base: DataFrame, original: DataFrame, changed: DataFrame, layouts: DataFrame, *, kind: str = "z") -> DataFrame:
    """The profile of ``changed``, which differs from ``original``, the series of ``base``, in [a, b) of the layout only.

    Windows that meet [a, b) are computed; all others are taken from ``base``. A change outside [a, b) is an error.
    """
    spans = layouts.select("series_id", "a", "b")
    both = changed.select("series_id", "idx", "x").join(original.select("series_id", "idx", F.col("x").alias("_x")), ["series_id", "idx"], "left").join(spans, "series_id")
    outside = ((F.col("idx") < F.col("a")) | (F.col("idx") >= F.col("b"))) & ~F.col("x").eqNullSafe(F.col("_x"))
    held = both.select("series_id", "idx", F.when(outside, F.raise_error(F.format_string("series %s is changed outside its region", F.col("series_id").cast("string"))).cast("double")).otherwise(F.col("x")).alias("x"))
    new = matrix_profile(held, layouts, kind=kind, starts=touched(F.col("a"), F.col("b")))
    old = base.join(layouts.select("series_id", "w", "a", "b"), "series_id").where(~touched(F.col("a"), F.col("b"))).select(*base.columns)
    return old.unionByName(new)


def detection(scores: DataFrame, layouts: DataFrame) -> DataFrame:
    """One row a series: thresholds, whether the labelled interval exceeds them, and where the test part peaks.

    ``thr_b0`` and ``thr_bw`` are 99th percentiles of normal test points without and with a buffer of w; ``p1`` compares
    the interval's largest score strictly; ``argmax0`` is the first peak; ``p2_archive`` and ``p2_brief`` say whether it
    falls near the interval under two rules.
    """
    from heronry.operators.series import normal_test

    j = scores.join(layouts, "series_id")
    normal = {b: F.when(normal_test(F.lit(0) if b == "b0" else F.col("w")), F.col("score")) for b in ("b0", "bw")}
    inside = (F.col("idx") >= F.col("s0")) & (F.col("idx") < F.col("s1"))
    test = F.col("idx") >= F.col("te")
    peak = F.min_by(F.when(test, F.col("idx")), F.when(test, F.struct(-F.col("score"), F.col("idx"))))
    out = j.groupBy("series_id", "n", "te", "s0", "s1", "w").agg(F.max(F.when(inside, F.col("score"))).alias("max_anom"), *[F.percentile(v, F.lit(0.99)).alias(f"thr_{b}") for b, v in normal.items()], *[F.median(v).alias(f"med_{b}") for b, v in normal.items()], peak.alias("argmax0"))
    for b in ("b0", "bw"):
        out = out.withColumn(f"p1_{b}", F.col("max_anom") > F.col(f"thr_{b}"))
    begin, end, p = F.col("s0") + 1, F.col("s1"), F.col("argmax0") + 1
    size = end - begin + 1
    out = out.withColumn("p2_archive", (p > F.least(begin - size, begin - 100)) & (p < F.greatest(end + size, end + 100)))
    out = out.withColumn("p2_brief", (F.col("argmax0") >= F.col("s0") - 100) & (F.col("argmax0") < F.col("s1") + 100))
    scale = F.col("thr_bw") - F.col("med_bw")
    return out.withColumn("scale", F.when(scale > 0, scale))
