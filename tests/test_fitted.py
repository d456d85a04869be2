"""Stored detectors, profiles by tiles and bounds, detectors in SQL."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import diagonals as D
from heronry.operators import forest as O
from heronry.operators import models as M
from heronry.operators import profile as P
from heronry.operators import table_functions

LAYOUT = "series_id {}, n long, te long, s0 long, s1 long, w long"


def made(spark, series, w, te=0.4, kind="long"):
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    lay = [(k, len(x), int(len(x) * te), len(x) - 20, len(x) - 15, w) for k, x in series.items()]
    return spark.createDataFrame(rows, f"series_id {kind}, idx long, x double"), spark.createDataFrame(lay, LAYOUT.format(kind))


def walks(seed=1, n=900):
    rng = np.random.default_rng(seed)
    walk = rng.normal(size=n).cumsum()
    flat = np.where(np.arange(n) % 200 < 60, 3.0, rng.integers(0, 3, n))
    copy = np.concatenate((walk[: n // 2], walk[: n // 2] * 2 + 1))
    return {1: walk + 1e4, 2: flat.astype(float), 3: copy, 4: rng.normal(size=15)}


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


# --- scans along diagonals


@pytest.mark.parametrize("kind", ["z", "raw"])
def test_a_scan_gives_the_distances_of_products(kind):
    rng = np.random.default_rng(0)
    for it in range(12):
        m = int(rng.integers(3, 40))
        x = rng.normal(size=900).cumsum() if it % 2 else rng.integers(0, 3, 900).astype(float)
        if it % 3 == 0:
            x[100:200], x[600:650] = 5.0, 7.0
        x += 1000 * (it % 5)
        q, r = x[:500], x[200:]
        for exclusion in (None, -(-m // 4)):
            want, at = P.nearest(q, r, m, kind=kind, first=0, first_ref=200, exclusion=exclusion)
            got, where, live = D.scan(q, r, m, kind=kind, first=0, first_ref=200, exclusion=exclusion)
            assert live.all() and np.allclose(want, got, rtol=1e-12, atol=1e-9)
            other = where != at  # of equal ones within rounding
            assert np.allclose(got[other], want[other], rtol=1e-12, atol=1e-9) and other.mean() < 0.05
            best = want * rng.choice([1.0, 2.0, 0.5], len(want))
            some, _, live = D.scan(q, r, m, kind=kind, first=0, first_ref=200, exclusion=exclusion, best=best)
            assert np.isinf(some[~live]).all() and (want[~live] > best[~live]).all() and np.allclose(some[live], want[live], rtol=1e-12, atol=1e-9)


def test_summaries_bound_distances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300).cumsum()
    for m in (5, 8, 30):
        s = D.summary(x, m, "z")
        z, _ = P._windows(x, m, "z")
        i, j = rng.integers(0, len(z), (2, 500))
        assert (np.linalg.norm(s[i] - s[j], axis=1) <= np.linalg.norm(z[i] - z[j], axis=1) + 1e-9).all()


@pytest.mark.parametrize("mode", ["ab_join", "self_join"])
@pytest.mark.parametrize("kind", ["z", "raw"])
def test_pruned_profile_is_the_profile(spark, mode, kind):
    series, lay = made(spark, walks(), 12)
    want = {r[:2]: r[2:] for r in rows(P.matrix_profile(series, lay, mode=mode, kind=kind), "series_id", "start", "dist", "nearest")}
    profile, work = D.pruned_profile(series, lay, mode=mode, kind=kind, rows=50, reach=120)
    got = {r[:2]: r[2:] for r in rows(profile, "series_id", "start", "dist", "nearest")}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want) and sum(got[k][1] != want[k][1] for k in want) < 0.02 * len(want)
    seen = {r.series_id: r for r in work.collect()}
    ref = (lambda n: int(n * 0.4)) if mode == "ab_join" else (lambda n: n)
    for k, x in walks().items():
        if ref(len(x)) >= 12:
            assert seen[k].tiles == -(-(len(x) - 11) // 50) * -(-(ref(len(x)) - 11) // 120)
    assert sum(r.windows_skipped for r in seen.values()) > 0


def test_one_long_series_is_dealt_out_and_cut_down(spark):
    rng = np.random.default_rng(5)
    x = np.sin((np.arange(6000) % 3000 / 400) ** 3) + 0.002 * rng.normal(size=6000)  # a chirp, and again
    series, lay = made(spark, {1: x}, 64, te=0.5)
    profile, work = D.pruned_profile(series, lay, rows=128, reach=128)
    w = work.first()
    assert w.tiles == 47 * 23 and w.tiles_skipped > 0 and w.windows_skipped > 0.3 * w.windows
    want = P.matrix_profile(series, lay)
    both = profile.join(want.withColumnRenamed("dist", "d"), ["series_id", "start"])
    assert both.count() == 6000 - 63 and both.agg(F.max(F.abs(F.col("d") - F.col("dist")))).first()[0] < 1e-9


def test_windows_that_repeat_training_move_no_tiles(spark, monkeypatch):
    """What equals a window of training is found by a key; what doesn't moves by cells, and the rows are those of the profile."""
    rng = np.random.default_rng(6)
    x = np.tile(rng.normal(size=500), 6)
    y = np.concatenate((x[:2500], rng.normal(size=500)))
    monkeypatch.setattr(D, "CELL", 300)
    series, lay = made(spark, {1: x, 2: y}, 16)
    profile, work = D.pruned_profile(series, lay, rows=50, reach=100)
    seen = {r.series_id: r for r in work.collect()}
    assert seen[1].tiles_skipped == seen[1].tiles == 60 * 12 and seen[1].windows == 0
    assert 0 < seen[2].tiles - seen[2].tiles_skipped <= 11 * 12
    both = profile.join(P.matrix_profile(series, lay).select("series_id", "start", F.col("dist").alias("d"), F.col("nearest").alias("j")), ["series_id", "start"])
    assert both.count() == 2 * 2985 and both.where("abs(d - dist) > 1e-9 OR nearest <> j").count() == 0


def test_pairs_of_blocks_move_before_the_kernel(spark):
    series, lay = made(spark, walks(), 12)
    plan = P.matrix_profile(series, lay, block=64)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas") :].split("\n")[1:3]
    assert any("Exchange hashpartitioning(series_id" in x and "lo#" in x and "r0#" in x and "REPARTITION_BY_NUM" in x for x in below)


# --- stored models


def test_profile_model_without_its_training_data(spark, tmp_path):
    series, lay = made(spark, walks(), 12)
    series.write.parquet(f"{tmp_path}/train")
    model = M.fit_profile(spark.read.parquet(f"{tmp_path}/train"), lay, str(tmp_path / "models"), "walks", block=100)
    shutil.rmtree(tmp_path / "train")
    want = rows(P.matrix_profile(series, lay), "series_id", "start", "dist", "nearest")
    loaded = M.load(spark, str(tmp_path / "models"), "walks", "profile", model.settings)
    got = rows(M.score_profile(loaded, series, block=70), "series_id", "start", "dist", "nearest")
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)
    ref = model.table(spark, "reference").where("series_id = 1").orderBy("r0").first()
    assert np.allclose(ref["mean"][:3], [np.mean(ref.ref[i : i + 12]) for i in range(3)]) and np.allclose(ref.sd[:3], [np.std(ref.ref[i : i + 12]) for i in range(3)])


def test_forest_and_kmeans_models_score_as_one_call(spark, tmp_path):
    folder = str(tmp_path)
    series, lay = made(spark, {k: x[:300] for k, x in walks().items()}, 10)
    trees = M.fit_forest(series, lay, folder, "f", trees=30, group=7, max_features=0.5)
    want = rows(O.isolation_forest(series, lay, trees=30, group=11, max_features=0.5), "series_id", "idx", "score")
    got = rows(M.score_forest(trees, series, group=4, block=90), "series_id", "idx", "score")
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    centres = M.fit_kmeans(series, lay, folder, "k")
    want = rows(O.kmeans_distance(series, lay), "series_id", "idx", "score")
    got = rows(M.score_kmeans(centres, series, block=64), "series_id", "idx", "score")
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_trees_by_brute_force():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(80, 6))
    tree = O.grow(points[:64][:, [0, 2, 5]], np.array([0, 2, 5]), np.random.default_rng(1), 6)
    for p, depth in zip(points, tree.depths(points)):
        at, steps = 0, 0
        while tree.feature[at] >= 0:
            at = tree.left[at] if p[tree.used[tree.feature[at]]] < tree.cut[at] else tree.right[at]
            steps += 1
        inside = sum(1 for q in points[:64] if _leaf(tree, q) == at)
        assert depth == pytest.approx(steps + float(O.expected_path(inside)))


def _leaf(tree, p):
    at = 0
    while tree.feature[at] >= 0:
        at = tree.left[at] if p[tree.used[tree.feature[at]]] < tree.cut[at] else tree.right[at]
    return at


def test_versions(spark, tmp_path):
    series, lay = made(spark, {"a-1": walks()[1][:200], "b": walks()[2][:200]}, 8, kind="string")
    folder = str(tmp_path)
    one = M.fit_forest(series, lay, folder, "m", trees=4)
    two = M.fit_forest(series, lay, folder, "m", trees=5)
    assert one.path != two.path and M.version_of("forest", {"a": 1, "b": 2}) == M.version_of("forest", {"b": 2, "a": 1})
    before = rows(one.table(spark, "trees"), "series_id", "tree", "cut")
    again = M.fit_forest(series.withColumn("x", F.lit(0.0)), lay, folder, "m", trees=4)  # it is there
    assert rows(again.table(spark, "trees"), "series_id", "tree", "cut") == before
    first, second = (one.table(spark, "trees").where((F.col("series_id") == s) & (F.col("tree") == 0)).first().cut for s in ("a-1", "b"))
    assert first != second  # text ids have draws of their own
    with pytest.raises(ValueError, match="no forest model"):
        M.load(spark, folder, "m", "forest", {"trees": 6})


# --- SQL


def test_table_function(spark):
    table_functions.register(spark)
    series, lay = made(spark, walks(), 12)
    series.join(lay, "series_id").createOrReplaceTempView("pts")
    got = {(r.series_id, r.idx): r.score for r in spark.sql("SELECT * FROM profile_scores(TABLE(pts))").collect()}
    want = {(r.series_id, r.idx): r.score for r in P.pad(P.matrix_profile(series, lay), lay.where("te >= w")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert spark.sql("SELECT * FROM profile_scores(TABLE(pts), 'self_join')").schema["series_id"].dataType == series.schema["series_id"].dataType
    with pytest.raises(Exception, match="unknown mode"):
        spark.sql("SELECT * FROM profile_scores(TABLE(pts), 'other')")
    with pytest.raises(Exception, match="lacks te, w"):
        spark.sql("SELECT * FROM profile_scores(TABLE(SELECT series_id, idx, x FROM pts))")


def test_trees_grown_together_are_those_grown_apart():
    """Any group gives the same trees; leaves count the training windows they hold; 200 trees of a short series take milliseconds."""
    import time

    rng = np.random.default_rng(4)
    train, points = rng.normal(size=(80, 6)), rng.normal(size=(50, 6))
    for features, sample in ((1.0, 256), (3, 64)):
        made = O.grow_trees(train, "s", range(40), sample=sample, max_features=features, seed=7)
        some = O.grow_trees(train, "s", range(30, 40), sample=sample, max_features=features, seed=7)
        assert (made.cut[30:] == some.cut).all() and (made.feature[30:] == some.feature).all() and (made.used[30:] == some.used).all()
        assert len(np.unique(made.cut[:, 0])) == 40
        apart = sum(O.grow_trees(train, "s", range(t, t + 1), sample=sample, max_features=features, seed=7).depths(points) for t in range(40))
        assert np.allclose(made.depths(points), apart)

    def leaf(p):
        at, steps = 0, 0
        while whole.feature[0, at] >= 0:
            at, steps = whole.left[0, at] + int(p[whole.used[0, whole.feature[0, at]]] >= whole.cut[0, at]), steps + 1
        return at, steps

    whole = O.grow_trees(train, "s", range(1), sample=256, max_features=1.0, seed=7)
    inside = [leaf(q)[0] for q in train]
    for p in train:
        at, steps = leaf(p)
        assert whole.depths(p[None])[0] == pytest.approx(steps + float(O.expected_path(inside.count(at))))
    flat = O.grow_trees(np.ones((30, 4)), 3, range(5), sample=256, max_features=1.0, seed=7)
    assert (flat.feature < 0).all() and flat.depths(np.ones((2, 4))) == pytest.approx(5 * float(O.expected_path(30)))
    one = time.process_time()
    O.grow_trees(train[:21], 1, range(200), sample=256, max_features=1.0, seed=7)
    together = time.process_time() - one
    one = time.process_time()
    for t in range(200):
        O.grow_tree(train[:21], 1, t, sample=256, max_features=1.0, seed=7)
    assert together < (time.process_time() - one) / 4


def test_pairs_are_compared_where_they_are_made(spark):
    """The pairs and correlations of the two steps; nothing that is dealt out for a join has a row a pair and point."""
    from heronry.operators import entity as E

    rng = np.random.default_rng(2)
    points = [(i, k, None if i == 3 and k == 4 else 1.0 if i == 5 else float(v)) for i in range(40) for k, v in enumerate(rng.normal(size=60 + i % 3))]
    series = spark.createDataFrame(points, "series_id long, idx long, x double")
    refs = spark.createDataFrame([(i, i // 4, "ab"[i % 2], 60 + i % 3, (0, 1, 20, 30)[i % 4]) for i in range(40)] + [(99, 0, "a", 60, 5)], "num long, name_group long, domain string, length long, te long")
    pairs = E.candidate_pairs(refs, tolerance=0.02)
    want = sorted(map(tuple, E.compare_pairs(pairs, series, refs.select(F.col("num").alias("series_id"), "te"), points=25, least=0.1).select("a", "b", "reason", "corr", "same").collect()), key=str)
    found = E.compare_candidates(refs, series, tolerance=0.02, points=25, least=0.1, parts=3)
    got = sorted(map(tuple, found.select("a", "b", "reason", "corr", "same").collect()), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and {r[2] for r in got} == {"name", "length"}
    assert all((g[3] is None) == (w[3] is None) and (g[3] is None or abs(g[3] - w[3]) < 1e-12) for g, w in zip(got, want, strict=True)) and any(g[3] is None for g in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_training_parts_of_pairs_are_compared_whole(spark, tmp_path):
    """Parts of several blocks give the correlation of all their points; the query's pairs of more than 5,000 training points too."""
    import datetime as dt

    import pandas as pd

    from heronry.operators import entity as E
    from heronry.plans import QUERIES

    rng = np.random.default_rng(4)
    points = [(i, k, None if i in (3, 6) and k % 5 == 0 or i == 7 and k >= 7 and k < 14 else 1.0 if i == 5 else 1e6 + float(v)) for i in range(16) for k, v in enumerate(rng.normal(size=60 + i % 3))]
    series = spark.createDataFrame(points, "series_id long, idx long, x double")
    refs = spark.createDataFrame([(i, i // 4, "ab"[i % 2], 60 + i % 3, (1, 5, 22, 30, 59, 61)[i % 6]) for i in range(16)] + [(99, 0, "a", 60, 50)], "num long, name_group long, domain string, length long, te long")
    ends = {r.num: r.te for r in refs.collect()}
    xs = {i: np.array([x for j, _, x in points if j == i], float) for i in ends}
    for bound in (None, 33):
        want = {}
        for a, b, reason in E.candidate_pairs(refs, tolerance=0.02).collect():
            k = min(ends[a], ends[b], bound or 1000, len(xs[a]), len(xs[b]))
            x, y = xs[a][:k], xs[b][:k]
            both = ~(np.isnan(x) | np.isnan(y))
            varies = k >= 2 and both.sum() >= 2 and all(np.ptp(v[both]) > 0 for v in (x, y))
            want[a, b, reason] = float(np.corrcoef(x[both], y[both])[0, 1]) if varies else None
        found = E.compare_candidates(refs, series, tolerance=0.02, points=bound, least=0.1, parts=3, block=7).collect()
        got = {(r.a, r.b, r.reason): r.corr for r in found}
        assert len(got) == len(found) and got.keys() == want.keys() and {k[2] for k in got} == {"name", "length"}
        assert all(got[k] is None if w is None else abs(got[k] - w) < 1e-9 for k, w in want.items())
        assert all(r.same == (r.corr is not None and r.corr >= 0.1) for r in found)

    n, te = 14_000, 5_600
    x = rng.normal(size=(2, n))
    x[1, :5000] += 0.2 * x[0, :5000]
    x[1, 5000:te] += 20 * x[0, 5000:te]
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k) for k in range(n)]
    events = pd.concat([pd.DataFrame({"event_id": np.arange(n) + n * u, "ts": at, "user_id": u, "event_type": "click", "value": x[u]}) for u in (0, 1)])
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    (row,) = QUERIES["recording_pairs"](spark, str(tmp_path)).collect()
    whole, cut = (np.corrcoef(x[:, :k])[0, 1] for k in (te, 5000))
    assert (row.a, row.b, row.reason, row.same) == (0, 1, "name", True) and abs(row.corr - whole) < 1e-6 and cut < 0.3
