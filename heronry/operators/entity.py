"""Entity grouping, subsets, audits, sentinels."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import clean, ratio
from heronry.shared import dealt, written


# --- pairs and groups


def candidate_pairs(refs: DataFrame, *, tolerance: float = 0.01) -> DataFrame:
    """(a, b, reason): pairs worth comparing. Same name_group always; else same domain and lengths within ``tolerance`` of the longer.

    Equi-joins on group and on domain with a length bucket: lengths within the tolerance fall in the same or the next
    bucket of a geometric scale, so the range condition never meets a whole domain.
    """
    cols = ["num", "name_group", "domain", "length"]
    a, b = (refs.select(*[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    same = a.join(b, (F.col("name_group_a") == F.col("name_group_b")) & (F.col("num_a") < F.col("num_b"))).select(F.col("num_a").alias("a"), F.col("num_b").alias("b"), F.lit("name").alias("reason"))
    step = F.log(F.lit(1.0) / (F.lit(1.0) - F.lit(tolerance)))
    bucket = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / step)
    left = a.withColumn("k", bucket("length_a"))
    right = b.withColumn("k", F.explode(F.array(bucket("length_b") - 1, bucket("length_b"), bucket("length_b") + 1)))
    near = F.abs(F.col("length_a") - F.col("length_b")) <= F.lit(tolerance) * F.greatest("length_a", "length_b")
    other = left.join(right, (F.col("domain_a") == F.col("domain_b")) & (left["k"] == right["k"]) & (F.col("num_a") < F.col("num_b")) & (F.col("name_group_a") != F.col("name_group_b")) & near)
    return same.union(other.select(F.col("num_a").alias("a"), F.col("num_b").alias("b"), F.lit("length").alias("reason")))


def compare_candidates(refs: DataFrame, series: DataFrame, *, tolerance: float = 0.01, points: int | None = None, least: float = 0.95, parts: int = 4, block: int = 1000) -> DataFrame:
    """(a, b, reason, corr, same): the pairs of :func:`candidate_pairs` as :func:`compare_pairs` compares them, where pairs are many.

    Training parts are compared whole, or up to ``points``. ``refs`` also has ``te``; idx of a series runs from 0 without
    gaps. Training parts go along with the series, in blocks, and a pair is compared where it is made: what moves grows with
    the series, not with their pairs. Only where both parts are longer than a block do a pair's moments move, a row a block.
    A group or bucket is dealt in ``parts``.
    """
    used = series if points is None else series.where(F.col("idx") < points)
    train = used.groupBy(F.col("series_id").alias("num"), F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("p"))
    te = F.col("te") if points is None else F.least("te", F.lit(points))
    left_over = F.greatest(te - F.coalesce("block", F.lit(0)) * block, F.lit(0))
    held = refs.join(train, "num", "left").withColumn("n", left_over).where("coalesce(block, 0) = 0 OR n > 0")
    held = held.select("num", "name_group", "domain", "length", F.coalesce("block", F.lit(0)).cast("long").alias("block"), (F.max("block").over(Window.partitionBy("num")) > 0).alias("long"), F.coalesce(F.slice(F.transform("p", lambda p: p["x"]), 1, F.least("n", F.lit(block)).cast("int")), F.array().cast("array<double>")).alias("xs"))
    held = written(held.withColumn("long", F.coalesce("long", F.lit(False))), "training-parts")
    step = F.log(F.lit(1.0) / (F.lit(1.0) - F.lit(tolerance)))
    bucket = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / step)
    near = F.abs(F.col("length_a") - F.col("length_b")) <= F.lit(tolerance) * F.greatest("length_a", "length_b")

    def met(rows: DataFrame, *also: str) -> DataFrame:
        """The pairs of ``rows`` that are worth comparing and agree in the columns ``also``."""
        a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in also], *also) for s in "ab")
        a = a.withColumn("part", F.pmod(F.xxhash64("num_a"), F.lit(parts)))
        b = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        keys = ["g", "part", *also]
        by_name = dealt(a.where("name_group_a IS NOT NULL").withColumn("g", F.col("name_group_a")), *keys).join(dealt(b.withColumn("g", F.col("name_group_b")), *keys), keys).where("num_a < num_b").withColumn("reason", F.lit("name"))
        keys = ["g", "k", "part", *also]
        left = dealt(a.withColumn("g", F.col("domain_a")).withColumn("k", bucket("length_a")), *keys)
        right = dealt(b.withColumn("g", F.col("domain_b")).withColumn("k", F.explode(F.array(bucket("length_b") - 1, bucket("length_b"), bucket("length_b") + 1))), *keys)
        by_length = left.join(right, keys).where((F.col("num_a") < F.col("num_b")) & (F.col("name_group_a") != F.col("name_group_b")) & near).withColumn("reason", F.lit("length"))
        columns = [F.col("num_a").alias("a"), F.col("num_b").alias("b"), "reason", "long_a", "long_b", "xs_a", "xs_b", *also]
        return by_name.select(*columns).union(by_length.select(*columns))

    def moments(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """(rows, (count, means, sums of squares and products about them, ranges)) of the pairs of a length and their common beginning."""
        sides = []
        for c in ("xs_a", "xs_b"):
            v = batch[c]
            sides.append((v.offsets.to_numpy().astype(np.int64), v.values.to_numpy(zero_copy_only=False).astype(float)))
        n = np.minimum(*(np.diff(o) for o, _ in sides))
        for size in np.unique(n[n >= 1]):
            rows = np.flatnonzero(n == size)
            for some in np.array_split(rows, -(-len(rows) * int(size) // (1 << 20))):
                x, y = (v[o[some][:, None] + np.arange(size)] for o, v in sides)
                both = ~(np.isnan(x) | np.isnan(y))
                with np.errstate(invalid="ignore", divide="ignore"), warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)  # sides of nulls only
                    ranges = [f(v, axis=1) for v in (x, y) for f in (np.nanmin, np.nanmax)]
                    count = both.sum(axis=1)
                    means = [np.where(both, v, 0.0).sum(axis=1) / count for v in (x, y)]
                    x, y = (np.where(both, v - m[:, None], 0.0) for v, m in zip((x, y), means, strict=True))
                    yield some, (count, *means, (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1), *ranges)

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corr = np.full(batch.num_rows, np.nan)
            for some, (_, _, _, xx, yy, xy, x0, x1, y0, y1) in moments(batch):
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = xy / np.sqrt(xx * yy)
                    corr[some] = np.where((x1 > x0) & (y1 > y0) & np.isfinite(r), r, np.nan)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["reason"], pa.array(corr, mask=np.isnan(corr))], ["a", "b", "reason", "corr"])

    names = ["n", "mx", "my", "xx", "yy", "xy", "x0", "x1", "y0", "y1"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((len(names), batch.num_rows), np.nan)
            for some, found in moments(batch):
                out[:, some] = found
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["reason"], batch["block"], *[pa.array(v, mask=np.isnan(v)) for v in out]], ["a", "b", "reason", "block", *names])

    kind = refs.schema["num"].dataType.simpleString()
    short = met(held.where("block = 0").drop("block")).where("NOT (long_a AND long_b)")
    out = short.mapInArrow(correlated, f"a {kind}, b {kind}, reason string, corr double")
    if points is None or points > block:
        parted = met(held.where("long"), "block").mapInArrow(summed, f"a {kind}, b {kind}, reason string, block long, {', '.join(f'{c} double' for c in names)}")
        out = out.union(_over_blocks(parted, names))
    return out.withColumn("same", F.coalesce(F.col("corr") >= least, F.lit(False)))


def _over_blocks(parted: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, reason, corr) from moments of blocks, in the order of the blocks."""
    out = parted.groupBy("a", "b", "reason").agg(F.array_sort(F.collect_list(F.struct("block", *names))).alias("p"), *[f(c).alias(c) for c, f in zip(("x0", "x1", "y0", "y1"), (F.min, F.max) * 2, strict=True)])
    total = lambda of: F.aggregate(F.filter("p", lambda p: p["n"] > 0), F.lit(0.0), lambda t, p: t + of(p))
    out = out.withColumn("mx", total(lambda p: p["n"] * p["mx"]) / F.nullif(total(lambda p: p["n"]), F.lit(0.0))).withColumn("my", total(lambda p: p["n"] * p["my"]) / F.nullif(total(lambda p: p["n"]), F.lit(0.0)))
    dx, dy = (lambda p: p["mx"] - F.col("mx")), (lambda p: p["my"] - F.col("my"))
    xx, yy, xy = total(lambda p: p["xx"] + p["n"] * dx(p) * dx(p)), total(lambda p: p["yy"] + p["n"] * dy(p) * dy(p)), total(lambda p: p["xy"] + p["n"] * dx(p) * dy(p))
    r = clean(xy / F.nullif(F.sqrt(xx * yy), F.lit(0.0)))
    return out.select("a", "b", "reason", F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), r).alias("corr"))


def compare_pairs(pairs: DataFrame, series: DataFrame, trains: DataFrame, *, points: int = 5000, least: float = 0.95) -> DataFrame:
    """Pairs with ``corr`` over the first min(points, train of a, train of b) points and ``same``; constant or short ones are NULL and not the same."""
    x = lambda s: series.select(F.col("series_id").alias(s), "idx", F.col("x").alias(f"x{s}"))
    te = lambda s: trains.select(F.col("series_id").alias(s), F.col("te").alias(f"te{s}"))
    j = pairs.join(te("a"), "a").join(te("b"), "b").join(x("a"), "a").join(x("b"), ["b", "idx"]).where(F.col("idx") < F.least(F.lit(points), "tea", "teb"))
    ok = (F.count(F.lit(1)) >= 2) & (F.max("xa") > F.min("xa")) & (F.max("xb") > F.min("xb"))
    r = j.groupBy("a", "b").agg(F.when(ok, F.corr("xa", "xb")).alias("corr"))
    return pairs.join(r, ["a", "b"], "left").withColumn("same", F.coalesce(F.col("corr") >= least, F.lit(False)))


def components(nodes: DataFrame, edges: DataFrame, *, most_rounds: int = 100) -> DataFrame:
    """(num, root): the smallest node that links reach. Smallest labels spread along edges and jump to their label's label.

    Each round is written to the session's shared folder and ends when no label falls.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = nodes.select("num", F.col("num").alias("root"))
    for _ in range(most_rounds):
        beside = both.join(labels.select(F.col("num").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = labels.join(beside, labels.num == beside.a, "left").select("num", F.least("root", F.coalesce("r", "root")).alias("root"), F.col("root").alias("was"))
        jump = step.alias("s").join(step.select(F.col("num").alias("k"), F.col("root").alias("rr")), F.col("s.root") == F.col("k"), "left")
        step = jump.select("num", F.least("root", F.coalesce("rr", "root")).alias("root"), "was")
        step = written(step, "labels")
        labels = step.select("num", "root")
        if step.where("root < was").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def group_labels(labels: DataFrame) -> DataFrame:
    """``group``: cg and the smallest number of the group, three digits or more; ``group_size``."""
    return labels.withColumn("group", F.format_string("cg%03d", F.col("root"))).withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy("root")))


def grouping_disagreements(members: DataFrame, one: str, other: str) -> DataFrame:
    """(direction, key, members): groups of one kind that hold several of the other, both ways round."""

    def way(x: str, y: str, name: str) -> DataFrame:
        return members.groupBy(F.col(x).cast("string").alias("key")).agg(F.array_sort(F.collect_set(F.col(y).cast("string"))).alias("members")).where(F.size("members") > 1).select(F.lit(name).alias("direction"), "key", "members")

    return way(one, other, "split").union(way(other, one, "merged"))


# --- subsets


def subset_condition(rule: Mapping[str, object]) -> Column:
    """All of: {"col": ..., "is" | "in" | "not_in": value(s)}; values compare as text, NULL as "NA"."""
    parts = []
    for column, test in rule.items():
        text = F.coalesce(F.col(column).cast("string"), F.lit("NA"))
        for how, value in test.items() if isinstance(test, Mapping) else {"is": test}.items():
            values = [str(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])]
            if how not in ("is", "in", "not_in"):
                raise ValueError(f"unknown test {how!r}")
            parts.append(~text.isin(*values) if how == "not_in" else text.isin(*values))
    return reduce(lambda p, q: p & q, parts, F.lit(True))


def select_subsets(rows: DataFrame, subsets: Mapping[str, Mapping], names: Sequence[str]) -> DataFrame:
    """Rows in all the named subsets; an unknown name is an error."""
    unknown = [n for n in names if n not in subsets]
    if unknown:
        raise ValueError(f"unknown subsets {unknown}")
    return rows.where(reduce(lambda p, q: p & q, (subset_condition(subsets[n]) for n in names), F.lit(True)))


def subset_summary(rows: DataFrame, subsets: Mapping[str, Mapping], *, group: str, least: int = 30) -> DataFrame:
    """(subset, n_series, n_groups, descriptive_only) for every subset, in one pass."""
    tagged = rows.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(subset_condition(r), F.lit(n)) for n, r in subsets.items()]))))
    return tagged.groupBy("subset").agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct(group).alias("n_groups")).withColumn("descriptive_only", F.col("n_groups") < least)


def funnel(rows: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(step, name, n): rows left after each condition and all before it, in one pass."""
    aggs, so_far = [], F.lit(True)
    for i, (name, c) in enumerate(steps.items()):
        so_far = so_far & c
        aggs.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(so_far).alias("n")))
    return rows.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


# --- audits

#: What each flag means for a run.
SEVERITY = {"nan_or_inf": "STOP", "end_gt_len": "STOP", "begin_gt_end": "STOP", "begin_le_train_end": "STOP", "train_end_ge_len": "STOP", "const_train": "WARN", "const_series": "INFO", "short_train": "INFO"}


def audit(series: DataFrame, layouts: DataFrame) -> DataFrame:
    """(series_id, flags, severity): what is odd about each series; nothing raises. ``severity`` is the worst, or OK."""
    j = layouts.join(series, "series_id", "left")
    train = F.when(F.col("idx") < F.col("te"), F.col("x"))
    s = j.groupBy("series_id", "n", "te", "s0", "s1", "w").agg(F.count_if(clean(F.col("x")).isNull() & F.col("idx").isNotNull()).alias("odd"), F.min(train).alias("tmin"), F.max(train).alias("tmax"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    begin, end = F.col("s0") + 1, F.col("s1")
    tests = {"nan_or_inf": F.col("odd") > 0, "end_gt_len": end > F.col("n"), "begin_gt_end": begin > end, "begin_le_train_end": begin <= F.col("te"), "train_end_ge_len": F.col("te") >= F.col("n"), "const_train": F.col("tmin") == F.col("tmax"), "const_series": F.col("lo") == F.col("hi"), "short_train": F.col("te") < 4 * F.col("w")}
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    worst = F.lit("OK")
    for level in ("INFO", "WARN", "STOP"):
        names = [k for k in tests if SEVERITY[k] == level]
        worst = F.when(F.arrays_overlap("flags", F.array(*[F.lit(k) for k in names])), F.lit(level)).otherwise(worst)
    return s.select("series_id", flags.alias("flags")).withColumn("severity", worst)


def flag_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


# --- sentinels and outliers


def mad(values: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Median absolute deviation of each group."""
    med = values.groupBy(*keys).agg(F.median(x).alias("_m"))
    return values.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col(x) - F.col("_m"))).alias("mad"))


def sentinels(series: DataFrame, layouts: DataFrame, *, value: float = -999.0) -> DataFrame:
    """(series_id, idx, exact, part): points at the value or within 3 MADs of training of it, and where they stand."""
    j = series.join(layouts, "series_id")
    spread = mad(j.where("idx < te"), ["series_id"])
    near = j.join(spread, "series_id").where(F.abs(F.col("x") - value) <= 3 * F.col("mad"))
    part = F.when((F.col("idx") >= F.col("s0")) & (F.col("idx") < F.col("s1")), "in_gt").when(F.col("idx") < F.col("te"), "in_train").otherwise("in_test_normal")
    return near.select("series_id", "idx", (F.col("x") == value).alias("exact"), part.alias("part"))


def rolling_outliers(x: np.ndarray, reach: int) -> np.ndarray:
    """Distance of each value to the median of those ``reach`` or less away, over their median absolute deviation."""
    wide = np.concatenate((np.full(reach, np.nan), x, np.full(reach, np.nan)))
    near = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)
    m = np.nanmedian(near, axis=1)
    d = np.nanmedian(np.abs(near - m[:, None]), axis=1)
    off = np.abs(x - m)
    return np.where(d > 0, off / np.where(d > 0, d, 1.0), np.where(off > 0, np.inf, 0.0))


def outlier_ratio(series: DataFrame, *, reach: int = 25, block: int = 20_000) -> DataFrame:
    """(series_id, idx, ratio) of :func:`rolling_outliers`; 0 where a value is its median, infinity where only it is off.

    Median deviations of a moving window have no window function of their own, so series are packed and cut into blocks
    with ``reach`` points of their neighbours on either side, each an array job.
    """
    from heronry.operators.series import pack

    packed = pack(series).withColumn("at", F.explode(F.expr(f"sequence(0, size(xs) - 1, {block})")))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    cut = packed.select("series_id", "at", (F.col("at") - first).alias("skip"), F.least(F.lit(block), F.size("xs") - F.col("at")).alias("n"), F.slice("xs", first + 1, F.col("at") - first + block + reach).alias("xs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                out = rolling_outliers(np.asarray(r.xs, float), reach)[r.skip : r.skip + r.n]
                yield pd.DataFrame({"series_id": r.series_id, "idx": np.arange(r.at, r.at + r.n), "ratio": out})

    kind = series.schema["series_id"].dataType.simpleString()
    return cut.mapInPandas(run, f"series_id {kind}, idx long, ratio double")


def twin_check(indices: DataFrame, variants: DataFrame, ratios: DataFrame, *, least: float = 5.0) -> DataFrame:
    """Per variant: how many listed positions stand out there too; the status of the whole.

    ``indices``: (name_group, idx); ``variants``: (name_group, series_id, n). Positions outside the variant don't match.
    """
    j = variants.join(indices, "name_group").join(ratios, ["series_id", "idx"], "left")
    outside = F.col("idx") >= F.col("n")
    hit = ~outside & (F.coalesce(F.col("ratio"), F.lit(0.0)) >= least)
    out = j.groupBy("series_id").agg(F.count_if(hit).alias("confirmed"), F.count_if(~outside & ~hit).alias("absent"), F.count_if(outside).alias("length_mismatch"))
    status = F.when(F.col("confirmed") + F.col("absent") == 0, "length_mismatch").when(F.col("absent") == 0, "confirmed").when(F.col("confirmed") == 0, "absent").otherwise("partial")
    return out.withColumn("status", status)


def constant_windows(series: DataFrame, w: int) -> DataFrame:
    """(series_id, n_const): full windows whose largest value is the smallest."""
    f = Window.partitionBy("series_id").orderBy("idx").rowsBetween(0, w - 1)
    return series.withColumn("_c", (F.max("x").over(f) == F.min("x").over(f)) & (F.count("x").over(f) == w)).groupBy("series_id").agg(F.count_if(F.col("_c")).alias("n_const"))


def local_deviation(series: DataFrame, *, near: int = 3, far: int = 12) -> DataFrame:
    """(series_id, idx, dev): distance to the median of points ``near`` to ``far`` away on both sides."""
    w = Window.partitionBy("series_id").orderBy("idx")
    both = F.concat(F.collect_list("x").over(w.rowsBetween(-far, -near)), F.collect_list("x").over(w.rowsBetween(near, far)))
    v = F.array_sort(both)
    n = F.size(v)
    med = (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2
    return series.select("series_id", "idx", F.when(n > 0, F.abs(F.col("x") - med)).alias("dev"))


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and listed columns, with a total row and column."""
    r = F.coalesce(F.col(row), F.lit("NA"))
    out = rows.rollup(r.alias(row)).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))
    return out.withColumn(row, F.coalesce(row, F.lit("total")))


def histogram(rows: DataFrame, x: str, edges: Sequence[float]) -> DataFrame:
    """(bin, lo, hi, n) for fixed edges, empty bins too; the last bin is closed, values outside and NULLs are left out."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    last = len(edges) - 2
    e = F.array(*[F.lit(float(v)) for v in edges])
    k = F.size(F.filter(e, lambda v: v <= F.col(x))) - 1
    n = rows.where((F.col(x) >= float(edges[0])) & (F.col(x) <= float(edges[-1]))).groupBy(F.least(k, F.lit(last)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "bin", "left").fillna({"n": 0})


def four_cells(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Counts of every combination of boolean flags, empty ones too, with shares."""
    spark = rows.sparkSession
    from itertools import product

    grid = spark.createDataFrame([tuple(c) for c in product((False, True), repeat=len(flags))], ", ".join(f"{f} boolean" for f in flags))
    n = rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, list(flags), "left").fillna({"n": 0})
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def united(lists: DataFrame, key: str, values: str) -> DataFrame:
    """(key, values): the sorted union of a key's lists of indices, each index once; null lists and indices are left out."""
    return lists.select(key, F.explode(values).alias("_v")).where("_v IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("_v")).alias(values))
