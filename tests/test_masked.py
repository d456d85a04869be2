"""Donor lists and scores of masked series against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import masked as K
from heronry.operators import masking as M
from heronry.operators import metrics as X
from heronry.operators import series as S

W, N, TE, S0, S1 = 8, 220, 80, 150, 156


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    xs = {1: np.round(np.sin(np.arange(N) / 4) + 0.1 * rng.normal(size=N), 6), 2: rng.integers(0, 3, N).astype(float)}
    xs[1][S0:S1] += 2
    series = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "series_id long, idx long, x double").cache()
    lay = spark.createDataFrame([(k, N, TE, S0, S1, W) for k in xs], "series_id long, n long, te long, s0 long, s1 long, w long")
    return xs, series, lay, S.segments(lay, most=6)


def donor(x, run, runs, where="test"):
    """The reference rule in plain loops."""
    (a, b), c = run, max(1, W // 4)
    size = b - a
    lo, hi = (TE, N) if where == "test" else (0, TE)
    best = None
    for u in range(max(lo, c), min(hi, N - c) - size + 1):
        away = [(S0 - W, S1 + W)] + [f for p, q in runs for f in ((p - W + 1, q + W - 1), (p - c, p), (q, q + c))]
        if any(u < y and z < u + size for z, y in away):
            continue
        d = round(float(((x[u - c : u] - x[a - c : a]) ** 2).sum() + ((x[u + size : u + size + c] - x[b : b + c]) ** 2).sum()), 9)
        if best is None or (d, u) < best:
            best = (d, u)
    return best


def runs_of(segs, z):
    out = []
    for (a, b), kept in zip(segs, z):
        if not kept:
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def score(x):
    """The largest distance, of windows with their middle in the label, to training windows."""

    def z(v):
        return np.zeros(W) if np.ptp(v) == 0 else (v - v.mean()) / v.std()

    ref = [z(x[j : j + W]) for j in range(TE - W + 1)]
    flat = [np.ptp(x[j : j + W]) == 0 for j in range(TE - W + 1)]
    out = 0.0
    for i in range(S0 - W // 2, S1 - W // 2):
        v, f = z(x[i : i + W]), np.ptp(x[i : i + W]) == 0
        out = max(out, min(0.0 if f and g else np.sqrt(W) if f != g else np.linalg.norm(v - r) for r, g in zip(ref, flat)))
    return out


def test_donor_lists(data, spark):
    xs, series, lay, segments = data
    segs = [(r.a, r.b) for r in segments.where("series_id = 1").orderBy("seg").collect()]
    assert len(segs) > 3
    for where in ("test", "train"):
        table = K.donor_table(series, lay, segments, where=where)
        got = {(r.series_id, r.a, r.b): (r.d[0], r.u[0]) for r in table.collect()}
        want = {}
        for k, x in xs.items():
            for i in range(len(segs)):
                for j in range(i, len(segs)):
                    run = (segs[i][0], segs[j][1])
                    found = donor(x, run, [run], where)
                    if found:
                        want[(k, *run)] = found
        assert got == want
    a, b = segs[1][0], segs[2][1]
    points = series.join(lay, "series_id").withColumn("a", F.lit(a).cast("long")).withColumn("b", F.lit(b).cast("long"))
    same = {r.series_id: r.u for r in M.donors(points).collect()}
    got = K.donor_table(series, lay, segments).where((F.col("a") == a) & (F.col("b") == b))
    assert {r.series_id: r.u[0] for r in got.collect()} == same


def test_donors_among_other_runs(data, spark):
    xs, series, lay, segments = data
    segs = [(r.a, r.b) for r in segments.where("series_id = 1").orderBy("seg").collect()]
    rng = random.Random(1)
    sets = [runs_of(segs, [rng.random() < 0.5 for _ in segs]) for _ in range(25)]
    rows = [(k, n, a, b) for k in xs for n, s in enumerate(sets) for a, b in s]
    table = K.donor_table(series, lay, segments)
    got = {tuple(r)[:4]: r.u for r in K.donors_of(table, spark.createDataFrame(rows, "series_id long, mask long, a long, b long"), lay, "mask").collect()}
    for k, n, a, b in rows:
        want = donor(xs[k], (a, b), sets[n])
        assert got[k, n, a, b] == (want[1] if want else None)


def test_scores_of_masked_series(data, spark):
    xs, series, lay, segments = data
    segs = [(r.a, r.b) for r in segments.where("series_id = 1").orderBy("seg").collect()]
    rng = random.Random(2)
    sets = [[1] * len(segs), [0] * len(segs)] + [[int(rng.random() < 0.6) for _ in segs] for _ in range(30)]
    rows = [(k, n, z) for k in xs for n, z in enumerate(sets)]
    got = {(r.series_id, r.d): r.f for r in K.masked_scores(series, lay, segments, spark.createDataFrame(rows, "series_id long, d long, z array<int>")).collect()}
    assert len(got) == len(rows)
    for k, n, z in rows:
        y, runs = xs[k].copy(), runs_of(segs, z)
        found = [donor(xs[k], r, runs) for r in runs]
        if None in found:
            assert got[k, n] is None
            continue
        for (a, b), (_, u) in zip(runs, found):
            y[a:b] = xs[k][u : u + b - a]
        assert got[k, n] == pytest.approx(score(y), abs=1e-9)


def test_shapley_values_of_a_detector(data, spark):
    """All sets with their Shapley weights give the exact values; drawn sets come near, and add up."""
    from itertools import combinations
    from math import comb, factorial

    xs, series, lay, segments = data
    one = lay.where("series_id = 1")
    k = segments.where("series_id = 1").count()
    every = [[int(i in c) for i in range(k)] for r in range(k + 1) for c in combinations(range(k), r)]
    sets = spark.createDataFrame([(1, n, z) for n, z in enumerate(every)], "series_id long, d long, z array<int>")
    f = {tuple(r.z): r.f for r in K.masked_scores(series, one, segments.where("series_id = 1"), sets).collect()}
    assert all(v is not None for v in f.values())
    exact = [sum(factorial(sum(z)) * factorial(k - sum(z) - 1) / factorial(k) * (f[tuple(z[:i]) + (1,) + tuple(z[i + 1 :])] - f[tuple(z)]) for z in every if not z[i]) for i in range(k)]
    weighted = [(1, z, 1e6 if sum(z) in (0, k) else (k - 1) / (comb(k, sum(z)) * sum(z) * (k - sum(z))), f[tuple(z)]) for z in every]
    got = [r.value for r in X.kernel_shap(spark.createDataFrame(weighted, "series_id long, z array<int>, weight double, f double")).orderBy("seg").collect()]
    assert np.allclose(got, exact, atol=1e-4)
    drawn = X.coalitions(spark.createDataFrame([(1, k)], "series_id long, k long"), 2 * F.col("k") + 2046)
    near = X.kernel_shap(K.masked_scores(series, one, segments.where("series_id = 1"), drawn).select("series_id", "z", "weight", "f")).orderBy("seg").collect()
    assert np.allclose([r.value for r in near], exact, atol=0.2 * max(map(abs, exact)))
    assert sum(r.value for r in near) == pytest.approx(f[(1,) * k] - f[(0,) * k], abs=1e-3)


def test_draws_are_merged_and_short_series_move_once(data, spark, monkeypatch):
    """Equal draws count once with their weights added, and the sets of a short series are scored in one block that lists only its own runs."""
    from heronry.plans import QUERIES

    xs, series, lay, segments = data
    sized = segments.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"))
    drawn = X.coalitions(sized, 2 * F.col("k") + 2046)
    few = {(r.series_id, tuple(r.z)): r.weight for r in X.merged(drawn).collect()}
    every = drawn.collect()
    assert len(few) < len(every) / 2 and sum(few.values()) == sum(r.weight for r in every)
    assert all(0 < sum(r.z) < len(r.z) for r in every if r.weight == 1)
    monkeypatch.setattr(K, "donor_table", None)
    plan = K.masked_scores(series, lay, segments, drawn)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64" in plan and "% 64" not in plan and ", 64), " not in plan
    held = []
    monkeypatch.setattr(X, "kernel_shap", lambda rows, old=X.kernel_shap: held.append(rows) or old(rows))
    QUERIES["detector_shap"](spark, "/root/testdata/sf0.001")
    assert held[0].groupBy("series_id", "z").count().where("count > 1").isEmpty()
