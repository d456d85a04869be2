"""What a detector says of a series when segments of it are masked, for many sets of segments at once.

Masked segments that touch form runs. A run is filled from its donor, the stretch whose surroundings are most like the
run's own. A donor's distance depends on the run alone; which donors are allowed depends on the other runs. So the
candidates of every possible run are measured and sorted once, and a set of runs takes the first that its others leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators import profile as P
from heronry.operators import series as S
from heronry.shared import dealt, written

#: Sets of segments that one task scores at a time, and windows that are compared at a time.
SETS, WINDOWS = 256, 4096
#: Sets of segments times points of the series in a block that is dealt out.
BLOCK = 1 << 17


def _overlaps(u: np.ndarray, size: int, x: int, y: int) -> np.ndarray:
    """Whether [u, u + size) meets [x, y)."""
    return (u < y) & (u + size > x)


def _forbidden(a: int, b: int, w: int) -> list[tuple[int, int]]:
    """What a run [a, b) keeps donors away from: all it can reach, and its context."""
    c = max(1, w // 4)
    return [(a - w + 1, b + w - 1), (a - c, a), (b, b + c)]


def _candidates(x: np.ndarray, a: int, ends: list[int], lay, where: str, band: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the runs [a, b) with b of ``ends``: (b, starts, squared distances) of donors, best first, up to the first clear of the band."""
    n, te, w = len(x), int(lay.te), int(lay.w)
    c = max(1, w // 4)
    if a - c < 0:
        return
    span = np.lib.stride_tricks.sliding_window_view(x, c)
    before = ((span - x[a - c : a]) ** 2).sum(axis=1)  # by where the context begins; once for all ends
    for b in ends:
        if b + c > n:
            continue
        size = b - a
        lo, hi = (max(te, c), n - c) if where == "test" else (c, min(te, n - c))
        u = np.arange(lo, hi - size + 1)
        for x0, x1 in [(int(lay.s0) - w, int(lay.s1) + w), *_forbidden(a, b, w)]:
            u = u[~_overlaps(u, size, x0, x1)]
        after = ((span[u + size] - x[b : b + c]) ** 2).sum(axis=1) if len(u) else np.zeros(0)
        d = np.round(before[u - c] + after, 9)
        order = np.lexsort((u, d))
        u, d = u[order], d[order]
        clear = np.flatnonzero(~_overlaps(u, size, band[0] - w + 1, band[1] + w - 1))
        if len(clear):  # it is allowed whatever other runs of the band there are
            u, d = u[: clear[0] + 1], d[: clear[0] + 1]
        yield b, u, d


def donor_table(series: DataFrame, layouts: DataFrame, segments: DataFrame, *, where: str = "test") -> DataFrame:
    """(series_id, a, b, u, d) for every run of adjacent segments: candidate starts and distances as arrays, best first.

    Rules are those of :func:`heronry.operators.masking.donors`. A list ends with the first donor that no run within the
    segments' band can forbid, so it has few entries whatever the series' length. A run without a candidate has no row.
    Work is dealt out by series and first segment; distances to the left context are computed once for all its runs.
    """
    id_type = series.schema["series_id"].dataType.simpleString()
    segs = segments.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    tasks = layouts.select("series_id", "te", "s0", "s1", "w").join(segs, "series_id").join(S.pack(series), "series_id")
    tasks = tasks.select("series_id", "te", "s0", "s1", "w", "xs", F.col("s.b").alias("ends"), F.get("s", 0)["a"].alias("band"), F.posexplode("s.a").alias("i", "a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ends = [int(b) for b in r.ends]
                found = [(int(r.a), b, u, d) for b, u, d in _candidates(np.asarray(r.xs, float), int(r.a), ends[int(r.i) :], r, where, (int(r.band), ends[-1])) if len(u)]
                if found:
                    a, b, u, d = zip(*found, strict=True)
                    yield pd.DataFrame({"series_id": r.series_id, "a": a, "b": b, "u": u, "d": d})

    return dealt(tasks, "series_id", "i").mapInPandas(run, f"series_id {id_type}, a long, b long, u array<long>, d array<double>")


def donors_of(table: DataFrame, runs: DataFrame, layouts: DataFrame, key: str) -> DataFrame:
    """(series_id, key, a, b, u): for the runs (series_id, key, a, b) of each set ``key`` the first donor that the others leave, or null."""
    others = runs.groupBy("series_id", key).agg(F.collect_list(F.struct("a", "b")).alias("o"))
    j = runs.join(table, ["series_id", "a", "b"], "left").join(others, ["series_id", key]).join(layouts.select("series_id", "w"), "series_id")
    size, w = F.col("b") - F.col("a"), F.col("w")
    meets = lambda u, x, y: (u < y) & (u + size > x)
    c = F.greatest(F.lit(1).cast("long"), F.floor(w / 4))
    hit = lambda u, o: ~((o["a"] == F.col("a")) & (o["b"] == F.col("b"))) & (meets(u, o["a"] - w + 1, o["b"] + w - 1) | meets(u, o["a"] - c, o["a"]) | meets(u, o["b"], o["b"] + c))
    free = F.filter("u", lambda u: ~F.exists("o", lambda o: hit(u, o)))
    return j.select("series_id", key, "a", "b", F.get(free, 0).alias("u"))


class _Masked:
    """One series, its segments and donors, and the windows that count."""

    def __init__(self, r, where: str) -> None:
        self.x, self.w, te = np.asarray(r.xs, float), int(r.w), int(r.te)
        self.a, self.b = [int(v) for v in r.a], [int(v) for v in r.b]
        self.layout, self.where, self.donors = r, where, {}
        half = self.w // 2
        self.starts = np.arange(max(int(r.s0) - half, 0), min(int(r.s1) - half, len(self.x) - self.w + 1))
        self.ref = P.normalised(np.lib.stride_tricks.sliding_window_view(self.x[:te], self.w), "z")
        self.views = self.starts[:, None] + np.arange(self.w)[None]

    def distances(self, v: np.ndarray) -> np.ndarray:
        a, ca = P.normalised(v, "z")
        out = np.full(len(v), np.inf)
        for i in range(0, len(a), SETS):
            for j in range(0, len(self.ref[0]), WINDOWS):
                part = slice(j, j + WINDOWS)
                out[i : i + SETS] = np.minimum(out[i : i + SETS], P.least(a[i : i + SETS], ca[i : i + SETS], self.ref[0][part], self.ref[1][part])[0])
        return out

    def runs(self, kept: int) -> list[tuple[int, int]]:
        """Runs of the segments whose bit isn't set."""
        out: list[tuple[int, int]] = []
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            if not kept >> i & 1:
                if out and out[-1][1] == a:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
        return out

    def measure(self, runs: set[tuple[int, int]]) -> None:
        """List the donors of runs that haven't been met yet."""
        ends: dict[int, list[int]] = {}
        for a, b in sorted(runs - self.donors.keys()):
            ends.setdefault(a, []).append(b)
            self.donors[a, b] = []
        for a, bs in ends.items():
            for b, u, _ in _candidates(self.x, a, bs, self.layout, self.where, (self.a[0], self.b[-1])):
                self.donors[a, b] = u.tolist()

    def filled(self, runs: list[tuple[int, int]]) -> np.ndarray | None:
        """The series with masked runs filled from their donors; None where a run has none."""
        x = self.x
        out = x.copy()
        for run in runs:
            size = run[1] - run[0]
            away = [f for o in runs if o != run for f in _forbidden(*o, self.w)]
            u = next((u for u in self.donors[run] if not any(u < y and u + size > z for z, y in away)), None)
            if u is None:
                return None
            out[run[0] : run[1]] = x[u : u + size]
        return out

    def scores(self, sets: list[int]) -> list[float | None]:
        """The largest distance of windows around the label, for each set of kept segments (as bits)."""
        base = self.distances(self.x[self.views])
        runs = {k: self.runs(k) for k in set(sets)}
        self.measure({run for found in runs.values() for run in found})
        fills = {k: self.filled(found) for k, found in runs.items()}
        known = [k for k, f in fills.items() if f is not None]
        if not known:
            return [None] * len(sets)
        values = np.stack([fills[k][self.views] for k in known])  # set, window, point
        touched = (values != self.x[self.views][None]).any(axis=2)
        out = np.broadcast_to(base, touched.shape).copy()
        if touched.any():
            different, back = np.unique(values[touched], axis=0, return_inverse=True)  # sets share most of their windows
            out[touched] = self.distances(different)[back.ravel()]
        best = dict(zip(known, out.max(axis=1).tolist(), strict=True))
        return [best.get(k) for k in sets]


def masked_scores(series: DataFrame, layouts: DataFrame, segments: DataFrame, sets: DataFrame, *, where: str = "test") -> DataFrame:
    """``f`` for each row of ``sets`` (series_id, z, ...): the detector's largest score in the label, of the series with the
    segments masked where ``z`` is 0.

    The detector is the profile against the training part. Windows that a mask doesn't change keep their distance, and
    windows that sets share are compared once. ``f`` is null where a run has no donor. Series with more than 64 segments
    are an error; series without a training window, or whose label no window has its middle in, have no rows. Sets are
    dealt out in blocks, with the series: short series in one, long ones in up to 64. A block lists the donors of the runs
    that its sets have, and no others.
    """
    id_type = series.schema["series_id"].dataType.simpleString()
    segs = segments.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s")).select("series_id", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    half = F.floor(F.col("w") / 2)
    inside = (F.col("te") >= F.col("w")) & (F.col("s1") - half > 0) & (F.col("s0") - half <= F.col("n") - F.col("w"))
    held = layouts.where(inside).select("series_id", "te", "s0", "s1", "w").join(segs, "series_id").join(S.pack(series), "series_id")
    held = written(held, "masked-series")
    bits = F.when(F.size("z") > 64, F.raise_error(F.lit("more than 64 segments")).cast("long")).otherwise(F.aggregate(F.zip_with("z", F.sequence(F.lit(0), F.size("z") - 1), lambda v, i: F.when(v == 1, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda p, q: p.bitwiseOR(q)))
    different = sets.select("series_id", bits.alias("kept")).distinct()
    blocks = different.groupBy("series_id").agg(F.count(F.lit(1)).alias("c")).join(held.select("series_id", F.size("xs").alias("n")), "series_id")
    blocks = blocks.select("series_id", F.least(F.ceil(F.col("c") * F.col("n") / BLOCK), F.lit(64)).alias("m"))
    grouped = different.join(blocks, "series_id").groupBy("series_id", F.pmod(F.xxhash64("kept"), "m").alias("g")).agg(F.collect_list("kept").alias("sets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                masked = _Masked(r, where)
                sets = [int(k) for k in r.sets]
                for i in range(0, len(sets), SETS):
                    some = sets[i : i + SETS]
                    yield pd.DataFrame({"series_id": r.series_id, "kept": some, "f": pd.array(masked.scores([k & 0xFFFFFFFFFFFFFFFF for k in some]), dtype="Float64")})

    scored = dealt(grouped.join(held, "series_id"), "series_id", "g").mapInPandas(run, f"series_id {id_type}, kept long, f double")
    return sets.withColumn("kept", bits).join(scored, ["series_id", "kept"]).drop("kept")
