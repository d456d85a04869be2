"""Isolation forest and k-means over sliding windows, and the profile's own attribution.

Trees are independent: each task grows a few of them for a series and sends back the sums of path lengths of all
windows, which add up by window. A long series so spreads over as many tasks as there are groups of trees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.series import pack
from heronry.shared import dealt


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """A random tree as arrays over its nodes, the root first; ``feature`` is -1 at a leaf, ``value`` the path length there."""

    size: int
    used: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def depths(self, points: np.ndarray) -> np.ndarray:
        """Path length of each point (rows of all features)."""
        seen = points[:, self.used]
        at = np.zeros(len(points), np.int64)
        open_ = np.arange(len(points))
        while len(open_):
            node = at[open_]
            inner = self.feature[node] >= 0
            open_, node = open_[inner], node[inner]
            goes_left = seen[open_, self.feature[node]] < self.cut[node]
            at[open_] = np.where(goes_left, self.left[node], self.right[node])
        return self.value[at]


def grow(sample: np.ndarray, used: np.ndarray, rng: np.random.Generator, limit: int) -> Tree:
    """A random tree that isolates the rows of ``sample``, of features ``used``."""
    nodes: list[list[float]] = [[-1, 0.0, -1, -1, 0.0]]
    todo = [(sample, 0, 0)]
    while todo:
        s, at, depth = todo.pop()
        lo, hi = s.min(axis=0), s.max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth >= limit or len(s) <= 1 or not len(free):
            nodes[at][4] = depth + float(expected_path(len(s)))
            continue
        f = rng.choice(free)
        cut = rng.uniform(lo[f], hi[f])
        left = s[:, f] < cut
        nodes[at][:4] = [int(f), float(cut), len(nodes), len(nodes) + 1]
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        todo += [(s[left], len(nodes) - 2, depth + 1), (s[~left], len(nodes) - 1, depth + 1)]
    feature, cut, left, right, value = zip(*nodes, strict=True)
    return Tree(len(sample), used, np.array(feature, np.int64), np.array(cut, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float))


def grow_tree(train: np.ndarray, series_id: object, t: int, *, sample: int, max_features: int | float, seed: int) -> Tree:
    """Tree number ``t`` of a series, from its training windows; the draws are fixed by seed, series and number."""
    w, size = train.shape[1], min(sample, len(train))
    n = features_used(max_features, w)
    text = str(series_id)
    rng = np.random.default_rng([seed, int(text) if text.isdigit() else zlib.crc32(text.encode()), t])
    chosen = train[rng.choice(len(train), size, replace=False)]
    used = np.sort(rng.choice(w, n, replace=False)) if n < w else np.arange(w)
    return grow(chosen[:, used], used, rng, int(np.ceil(np.log2(max(size, 2)))))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 64-bit keys, mixed as splitmix64 does: the same whatever is drawn beside them."""
    with np.errstate(over="ignore"):
        z = key + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * (1.0 / (1 << 53))


@dataclass
class Trees:
    """Many trees of one series: (tree, node) arrays, a right child beside the left one."""

    size: int
    used: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def depths(self, points: np.ndarray) -> np.ndarray:
        """Sum over the trees of each point's path length."""
        tree = np.arange(len(self.feature))[:, None]
        row = np.arange(len(points))[None]
        at = np.zeros((len(self.feature), len(points)), np.int64)
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return self.value[tree, at].sum(axis=0)
            right = points[row, self.used[tree, np.maximum(f, 0)]] >= self.cut[tree, at]
            at = np.where(inner, self.left[tree, at] + right, at)


def grow_trees(train: np.ndarray, series_id: object, numbers: range, *, sample: int, max_features: int | float, seed: int) -> Trees:
    """Trees ``numbers`` of a series at once, level by level over all of them.

    A node's draws hang on seed, series, tree and node alone, so a tree is the same in any group. Where all training windows
    or all features are taken there is nothing to draw for them.
    """
    w, size, count = train.shape[1], min(sample, len(train)), len(numbers)
    n = features_used(max_features, w)
    text = str(series_id)
    ident = [seed, int(text) if text.isdigit() else zlib.crc32(text.encode())]
    used = np.tile(np.arange(w), (count, 1)) if n == w else np.empty((count, n), np.int64)
    rows = np.tile(np.arange(size), (count, 1)) if size == len(train) else np.empty((count, size), np.int64)
    if n < w or size < len(train):
        for i, t in enumerate(numbers):
            rng = np.random.default_rng([*ident, t])
            if size < len(train):
                rows[i] = rng.choice(len(train), size, replace=False)
            if n < w:
                used[i] = np.sort(rng.choice(w, n, replace=False))
    x = train[rows[:, :, None], used[:, None, :]].reshape(count * size, n)
    base = np.random.SeedSequence(ident).generate_state(1, np.uint64)[0]
    limit = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (limit + 1) - 1
    feature, cut = np.full((count, nodes), -1, np.int64), np.zeros((count, nodes))
    value = np.tile(np.floor(np.log2(np.arange(nodes) + 1.0)), (count, 1))  # of a node that no row reaches
    at, tree = np.zeros(count * size, np.int64), np.repeat(np.arange(count), size)
    for depth in range(limit + 1):
        group = tree * nodes + at
        order = np.argsort(group, kind="stable")
        x, at, tree, group = x[order], at[order], tree[order], group[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        many = np.diff(np.append(first, len(group)))
        lo, hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        free = hi > lo
        choices = free.sum(axis=1)
        split = (choices > 0) & (depth < limit)
        t, node = tree[first], at[first]
        value[t[~split], node[~split]] = depth + expected_path(many[~split])
        if not split.any():
            break
        with np.errstate(over="ignore"):
            key = base + (np.asarray(numbers, np.uint64)[t[split]] << np.uint64(32)) + np.uint64(2) * node[split].astype(np.uint64)
        pick = np.minimum((_uniform(key) * choices[split]).astype(np.int64), choices[split] - 1)
        f = (np.cumsum(free[split], axis=1) == pick[:, None] + 1).argmax(axis=1)
        here = np.arange(len(f))
        low, high = lo[split][here, f], hi[split][here, f]
        feature[t[split], node[split]] = f
        cut[t[split], node[split]] = low + (high - low) * _uniform(key + np.uint64(1))
        goes_on = np.repeat(split, many)
        x, at, tree = x[goes_on], at[goes_on], tree[goes_on]
        at = 2 * at + 1 + (x[np.arange(len(x)), feature[tree, at]] >= cut[tree, at])
    return Trees(size, used, feature, cut, np.where(feature >= 0, 2 * np.arange(nodes) + 1, -1), value)


def features_used(max_features: int | float, w: int) -> int:
    """How many of w features a tree sees: an integer is that many (1 is one), a fraction that share of them (1.0 is all)."""
    n = max_features if isinstance(max_features, int) else int(max_features * w)
    if not 1 <= n <= w:
        raise ValueError(f"max_features {max_features!r} of {w} features")
    return n


def isolation_forest(series: DataFrame, layouts: DataFrame, *, trees: int = 200, sample: int = 256, max_features: int | float = 1.0, group: int = 25, block: int = 4096, seed: int = 7) -> DataFrame:
    """(series_id, idx, score): 2^(-mean path / expected path) of windows, trained on those inside [0, te).

    A window's score stands at its middle; the first and last score fill the edges. A task grows ``group`` trees on the
    training part, all trees where the series is one block, and follows a block of windows through them.
    """
    per = F.when(F.size("xs") - F.col("w") < block, trees).otherwise(group).alias("per")
    tasks = layouts.join(pack(series), "series_id").where("te >= w").withColumn("per", per).withColumn("g", F.explode(F.expr(f"sequence(0, int(ceil({trees} / per)) - 1)")))
    tasks = tasks.withColumn("first", F.explode(F.expr(f"sequence(0, size(xs) - int(w), {block})")))
    m = F.col("w").cast("int")
    narrow = dealt(tasks.select("series_id", "w", "g", "per", "first", F.expr("slice(xs, 1, int(te))").alias("train"), F.slice("xs", F.col("first") + 1, F.least(F.lit(block) + m - 1, F.size("xs") - F.col("first"))).alias("part")), "series_id", "g", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for r in batch.itertuples():
                train, v = (np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), int(r.w)) for x in (r.train, r.part))
                grown = grow_trees(train, r.series_id, range(r.g * r.per, min((r.g + 1) * r.per, trees)), sample=sample, max_features=max_features, seed=seed)
                out.append((r.series_id, np.arange(r.first, r.first + len(v)), grown.depths(v), grown.size))
                held += len(v)
                if held >= 1 << 16:
                    yield totals_table(out)
                    out, held = [], 0
            if out:
                yield totals_table(out)

    kind = series.schema["series_id"].dataType.simpleString()
    return forest_scores(narrow.mapInPandas(run, f"series_id {kind}, start long, total double, size long"), layouts, trees)


def totals_table(parts: list[tuple]) -> pd.DataFrame:
    """(series_id, start, total, size) of (series_id, starts, totals, size)."""
    ids, starts, totals, sizes = zip(*parts, strict=True)
    many = [len(v) for v in starts]
    return pd.DataFrame({"series_id": np.repeat(pd.Series(ids).to_numpy(), many), "start": np.concatenate(starts), "total": np.concatenate(totals), "size": np.repeat(sizes, many)})


def forest_scores(parts: DataFrame, layouts: DataFrame, trees: int) -> DataFrame:
    """(series_id, idx, score) from path lengths (series_id, start, total, size) of groups of trees."""
    sums = parts.groupBy("series_id", "start").agg(F.sum("total").alias("t"), F.max("size").alias("m"))
    log = F.log((F.col("m") - 1).cast("double")) + 0.5772156649015329
    c = F.when(F.col("m") > 2, 2 * log - F.lit(2.0) * (F.col("m") - 1) / F.col("m")).otherwise(F.lit(1.0))
    return _edges(sums.select("series_id", "start", F.pow(F.lit(2.0), -F.col("t") / trees / c).alias("v")), layouts)


def _edges(values: DataFrame, layouts: DataFrame) -> DataFrame:
    """Window values at ceil((w - 1) / 2) after their start; the first and last value fill the edges."""
    shift = F.ceil((F.col("w") - 1) / 2).cast("long")
    points = layouts.select("series_id", "n", "w", F.explode(F.expr("sequence(0L, n - 1)")).alias("idx"))
    at = points.withColumn("start", F.least(F.greatest(F.col("idx") - shift, F.lit(0)), F.col("n") - F.col("w")))
    return at.join(values, ["series_id", "start"]).select("series_id", "idx", F.col("v").alias("score"))


def _scaled(x: list[float], w: int, mean: float, sd: float) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view((np.asarray(x, float) - mean) / sd, w)


def kmeans_centres(series: DataFrame, layouts: DataFrame, *, k: int = 4, rounds: int = 20, seed: int = 7) -> DataFrame:
    """(series_id, w, mean, sd, centres): k centres of the z-scaled windows of each training part, a task a series."""
    packed = layouts.join(pack(series), "series_id").where("te >= w").select("series_id", "w", F.expr("slice(xs, 1, int(te))").alias("train"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.asarray(r.train, float)
                mean, sd = float(x.mean()), float(x.std() or 1.0)
                train = _scaled(r.train, int(r.w), mean, sd)
                rng = np.random.default_rng(seed)
                centres = train[rng.choice(len(train), min(k, len(train)), replace=False)].copy()
                for _ in range(rounds):
                    near = ((train[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                    for j in range(len(centres)):
                        if (near == j).any():
                            centres[j] = train[near == j].mean(axis=0)
                yield pd.DataFrame({"series_id": [r.series_id], "w": [int(r.w)], "mean": [mean], "sd": [sd], "centres": [centres.ravel().tolist()]})

    kind = series.schema["series_id"].dataType.simpleString()
    return packed.mapInPandas(fit, f"series_id {kind}, w long, mean double, sd double, centres array<double>")


def centre_distances(blocks: DataFrame, centres: DataFrame, layouts: DataFrame, id_type: str) -> DataFrame:
    """(series_id, idx, score) of blocks (series_id, w, first, part) of windows, by the centres of their series."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                v = _scaled(r.part, int(r.w), r.mean, r.sd)
                d = np.full(len(v), np.inf)
                for c in np.asarray(r.centres, float).reshape(-1, int(r.w)):
                    d = np.minimum(d, ((v - c) ** 2).sum(axis=1))
                yield pd.DataFrame({"series_id": r.series_id, "start": np.arange(r.first, r.first + len(v)), "v": np.sqrt(d)})

    each = dealt(blocks.join(centres.drop("w"), "series_id").select("series_id", "w", "first", "part", "mean", "sd", "centres"), "series_id", "first")
    return _edges(each.mapInPandas(measure, f"series_id {id_type}, start long, v double"), layouts)


def kmeans_distance(series: DataFrame, layouts: DataFrame, *, k: int = 4, rounds: int = 20, block: int = 4096, seed: int = 7) -> DataFrame:
    """(series_id, idx, score): distance of z-scaled windows to the nearest of k centres of the training part.

    Centres are found on the training part, a task a series; windows are then dealt out in blocks with the centres.
    """
    m = F.col("w").cast("int")
    packed = layouts.join(pack(series), "series_id").where("te >= w").select("series_id", "w", "xs")
    blocks = packed.withColumn("first", F.explode(F.expr(f"sequence(0, size(xs) - int(w), {block})"))).select("series_id", "w", "first", F.slice("xs", F.col("first") + 1, F.least(F.lit(block) + m - 1, F.size("xs") - F.col("first"))).alias("part"))
    return centre_distances(blocks, kmeans_centres(series, layouts, k=k, rounds=rounds, seed=seed), layouts, series.schema["series_id"].dataType.simpleString())


def nearest_difference(windows: DataFrame, profile: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, idx, v): squared z-difference, point by point, of the worst window that meets the label to its nearest one.

    ``windows``: (series_id, start, z). Of equally bad windows the first counts.
    """
    meets = (F.col("start") > F.col("s0") - F.col("w")) & (F.col("start") < F.col("s1"))
    worst = profile.join(layouts, "series_id").where(meets).groupBy("series_id").agg(F.min_by(F.struct("start", "nearest"), F.struct(-F.round("dist", 9), F.col("start"))).alias("j")).select("series_id", "j.start", "j.nearest")
    a = worst.join(windows, ["series_id", "start"])
    b = windows.select("series_id", F.col("start").alias("nearest"), F.col("z").alias("zn"))
    return a.join(b, ["series_id", "nearest"]).select("series_id", "start", F.posexplode(F.zip_with("z", "zn", lambda p, q: (p - q) * (p - q))).alias("k", "v")).select("series_id", (F.col("start") + F.col("k")).alias("idx"), "v")


def z_windows(series: DataFrame, w: int) -> DataFrame:
    """(series_id, start, z): z-normalised windows as arrays; constant ones are zeros."""
    from pyspark.sql import Window

    f = Window.partitionBy("series_id").orderBy("idx").rowsBetween(0, w - 1)
    v = series.select("series_id", F.col("idx").alias("start"), F.collect_list("x").over(f).alias("v"), F.avg("x").over(f).alias("mu"), F.stddev_pop("x").over(f).alias("sd")).where(F.size("v") == w)
    flat = F.array_max("v") == F.array_min("v")
    return v.select("series_id", "start", F.transform("v", lambda y: F.when(flat, F.lit(0.0)).otherwise((y - F.col("mu")) / F.col("sd"))).alias("z"))
