"""Operators against numpy and by their invariants."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.functions import numeric as N
from heronry.operators import entity as E
from heronry.operators import integrity as I
from heronry.operators import masking as M
from heronry.operators import metrics as X
from heronry.operators import profile as P
from heronry.operators import series as S
from heronry.operators import stats as T
from heronry.operators import trace as R


def make(spark, xs, te=30, s0=60, s1=63, w=6, a=45, b=48):
    series = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "series_id long, idx long, x double")
    lay = spark.createDataFrame([(k, len(x), te, s0, s1, w, a, b) for k, x in xs.items()], "series_id long, n long, te long, s0 long, s1 long, w long, a long, b long")
    return series, lay


@pytest.fixture(scope="module")
def xs():
    rng = np.random.default_rng(0)
    flat = np.sin(np.arange(100) / 4)
    flat[10:20] = 1.0
    flat[70:80] = -2.0
    return {1: rng.normal(size=100), 2: flat, 3: np.floor(rng.normal(size=100) * 2)}


def brute(x, ref, m, kind="z", exclusion=None):
    out = []
    for i in range(len(x) - m + 1):
        best = np.inf
        for j in range(len(ref) - m + 1):
            if exclusion is not None and abs(i - j) <= exclusion:
                continue
            u, v = x[i : i + m], ref[j : j + m]
            cu, cv = np.ptp(u) == 0, np.ptp(v) == 0
            if kind == "raw":
                d = np.linalg.norm(u - v)
            elif cu or cv:
                d = 0.0 if cu and cv else math.sqrt(m)
            else:
                d = np.linalg.norm((u - u.mean()) / u.std() - (v - v.mean()) / v.std())
            best = min(best, d)
        out.append(best)
    return np.array(out)


def test_matrix_profile(spark, xs):
    series, lay = make(spark, xs)
    for mode, kind in (("ab_join", "z"), ("ab_join", "raw"), ("self_join", "z")):
        for block in (16, 2048):
            got = P.matrix_profile(series, lay, mode=mode, kind=kind, block=block).orderBy("start").toPandas()
            for k, x in xs.items():
                want = brute(x, x[:30] if mode == "ab_join" else x, 6, kind, None if mode == "ab_join" else 2)
                assert np.allclose(got[got.series_id == k].dist, want, atol=1e-9)


def test_incremental_equals_full(spark, xs):
    series, lay = make(spark, xs)
    base = P.matrix_profile(series, lay)
    changed = M.mask(series.join(lay, "series_id"), "zero").select("series_id", "idx", F.col("masked").alias("x"))
    inc = P.incremental(base, series, changed, lay).orderBy("series_id", "start").toPandas()
    full = P.matrix_profile(changed, lay).orderBy("series_id", "start").toPandas()
    assert np.allclose(inc.dist, full.dist, atol=1e-12) and len(inc) == len(full)
    elsewhere = changed.withColumn("x", F.when(F.col("idx") == 2, 99.0).otherwise(F.col("x")))
    with pytest.raises(Exception, match="outside its region"):
        P.incremental(base, series, elsewhere, lay).collect()


def test_padding_and_detection(spark, xs):
    series, lay = make(spark, xs)
    prof = P.matrix_profile(series, lay)
    sc = P.pad(prof, lay).orderBy("series_id", "idx").toPandas()
    d = {r.series_id: r for r in P.detection(P.pad(prof, lay), lay).collect()}
    for k, x in xs.items():
        p = brute(x, x[:30], 6)
        want = np.full(100, p.min())
        want[3 : 3 + len(p)] = p
        assert np.allclose(sc[sc.series_id == k].score, want)
        idx = np.arange(100)
        m = (idx >= 30) & ~((idx >= 54) & (idx < 69))
        assert math.isclose(d[k].thr_bw, np.quantile(want[m], 0.99), abs_tol=1e-9)
        assert d[k].argmax0 == 30 + int(np.argmax(np.round(want[30:], 12))) or math.isclose(want[d[k].argmax0], want[30:].max())


def test_archive_rule(spark):
    cases = [(1150, 1249, 1250, True), (1149, 1249, 1250, False), (1348, 1249, 1250, True), (1349, 1249, 1250, False), (499, 999, 1500, True), (498, 999, 1500, False)]
    rows = [(i, j, 1.0 if j == p else 0.0) for i, (p, *_) in enumerate(cases) for j in {100, p}]
    lay = spark.createDataFrame([(i, 3000, 100, s0, s1, 10) for i, (_, s0, s1, _) in enumerate(cases)], "series_id long, n long, te long, s0 long, s1 long, w long")
    sc = spark.createDataFrame(rows, "series_id long, idx long, score double")
    got = {r.series_id: r.p2_archive for r in P.detection(sc, lay).collect()}
    assert got == {i: w for i, (*_, w) in enumerate(cases)}


@pytest.mark.parametrize("name", M.OPERATORS)
def test_masks_touch_only_the_region_and_are_repeatable(spark, xs, name):
    series, lay = make(spark, xs)
    pts = series.join(lay, "series_id")
    a = M.mask(pts, name).orderBy("series_id", "idx").toPandas()
    b = M.mask(pts, name).orderBy("series_id", "idx").toPandas()
    out = (a.idx < 45) | (a.idx >= 48)
    assert (a.masked[out] == a.x[out]).all() and np.allclose(a.masked, b.masked, rtol=1e-12)
    if name == "identity":
        assert (a.masked == a.x).all()
    if name == "linear":
        for k, x in xs.items():
            assert np.allclose(a[(a.series_id == k) & ~out].masked, np.linspace(x[44], x[48], 5)[1:-1])


def test_structured_masks(spark, xs):
    series, lay = make(spark, xs)
    pts = series.join(lay, "series_id")
    for df in (M.shuffle_inside(pts), M.neighbour_window(pts), M.context_reconstruct(pts)):
        o = df.where(~M.inside())
        assert o.count() == 3 * 97 and o.where("masked <> x").count() == 0
    s = M.shuffle_inside(pts).where(M.inside()).toPandas()
    for k, x in xs.items():
        assert sorted(s[s.series_id == k].masked) == sorted(x[45:48])
    n = M.neighbour_window(pts).where(M.inside()).orderBy("idx").toPandas()
    assert n[n.series_id == 1].masked.tolist() == [*xs[1][43:45], xs[1][48]]


def test_donor_is_the_nearest_clear_stretch(spark, xs):
    series, lay = make(spark, xs)
    got = {r.series_id: r.u for r in M.donors(series.join(lay, "series_id")).collect()}
    for k, x in xs.items():
        best = None
        for u in range(max(30, 1), min(100, 99) - 3 + 1):
            if any(u < hi and u + 3 > lo for lo, hi in ((54, 69), (40, 53), (44, 45), (48, 49))):
                continue
            d = round((x[u - 1] - x[44]) ** 2 + (x[u + 3] - x[48]) ** 2, 9)
            if best is None or (d, u) < best:
                best = (d, u)
        assert got[k] == best[1]


def test_kernel_shap_of_a_sum_is_its_terms(spark):
    v = np.array([1.0, -2.0, 0.5, 3.0])
    sized = spark.createDataFrame([(1, 4)], "series_id long, k long")
    z = X.coalitions(sized, 40)
    assert z.where("weight = 1").count() == 40 and z.where("weight > 1").count() == 2
    f = z.withColumn("f", F.aggregate(F.zip_with("z", F.array(*map(F.lit, v.tolist())), lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q))
    got = X.kernel_shap(f).orderBy("seg").toPandas()
    assert np.allclose(got.value, v, atol=1e-4)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 4), min_size=2, max_size=12), st.randoms(use_true_random=False))
def test_ranks_and_kendall_against_numpy(spark, values, rnd):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k long, item long, v double")
    got = [r.r for r in df.withColumn("r", N.average_rank(F.col("v"), ["k"])).orderBy("item").collect()]
    arr = np.array(values)
    assert got == [float((arr > v).sum() + ((arr == v).sum() + 1) / 2) for v in values]
    other = values[:]
    rnd.shuffle(other)
    pair = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(values, other))], "k long, item long, x double, y double")
    tau = T.kendall_tau(pair, ["k"]).first().tau
    s = [(np.sign(a - c), np.sign(b - e)) for i, (a, b) in enumerate(zip(values, other)) for c, e in list(zip(values, other))[i + 1 :]]
    den = math.sqrt(sum(abs(p) for p, _ in s) * sum(abs(q) for _, q in s))
    assert (tau is None) if den == 0 else math.isclose(tau, sum(p * q for p, q in s) / den, abs_tol=1e-12)


def test_kendall_w_and_wilcoxon(spark):
    same = [(r, i, float(i)) for r in range(3) for i in range(5)]
    df = spark.createDataFrame(same, "rater int, item int, rank double")
    assert T.kendall_w(df, []).first().w == 1.0
    d = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 5, 6, 7, -8)] + [(2, 0.0)], "k int, d double")
    out = {r.k: r for r in T.wilcoxon(d, ["k"]).collect()}
    assert (out[1].w_plus, out[1].w_minus, out[2].p) == (28.0, 8.0, 1.0) and 0.1 < out[1].p < 0.2
    z = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)], "z double")
    for r in z.select("z", T.normal_cdf(F.col("z")).alias("p")).collect():
        assert math.isclose(r.p, 0.5 * (1 + math.erf(r.z / math.sqrt(2))), abs_tol=1e-7)


def test_dds_matches_its_definition(spark):
    rng = np.random.default_rng(1)
    m, l = rng.uniform(0, 9, 11), rng.uniform(0, 9, 11)  # noqa: E741
    w = ((11 - np.arange(11)) / 11) ** 3
    want = ((l - m) * w).sum() / w.sum() / (2.5 * w[1:].sum() / w.sum())
    df = spark.createDataFrame([(m.tolist(), l.tolist()), ([1.0], [1.0])], "m array<double>, l array<double>")
    got = [r.d for r in df.select(X.dds(F.col("m"), F.col("l"), F.lit(2.5)).alias("d")).collect()]
    assert math.isclose(got[0], want) and got[1] is None


def test_intervals_allocation_selection(spark):
    st_ = spark.createDataFrame([("a", 70), ("b", 25), ("c", 4), ("d", 1)], "stratum string, n long")
    got = {r.stratum: r.seats for r in T.allocate(st_, 10).collect()}
    assert got == {"a": 7, "b": 2, "c": 1, "d": 1}
    jobs = spark.createDataFrame([(c,) for c in (5.0, 4.0, 3.0, 3.0, 3.0)], "cost double")
    assert T.makespan(jobs, 2).first().makespan == 10.0
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (50, 3))
    facts = spark.createDataFrame([(*map(float, r), float(2 * r[0] + 3 * r[2])) for r in x], "a double, b double, c double, y double")
    assert np.allclose(T.nnls3(facts, ("a", "b", "c"), "y"), (2, 0, 3), atol=1e-6)
    cand = spark.createDataFrame([(1, a, 3) for a in range(20)], "series_id long, a long, len long")
    picked = [r.a for r in T.disjoint(cand, 4).collect()]
    assert len(picked) == 4 and all(abs(p - q) >= 3 for i, p in enumerate(picked) for q in picked[i + 1 :])
    for conv in ("one_based_inclusive", "zero_based_inclusive", "zero_based_half_open"):
        a, b = N.to_half_open(F.lit(7), F.lit(9), conv)
        assert tuple(spark.range(1).select(*N.from_half_open(a, b, conv)).first()) == (7, 9)
    with pytest.raises(ValueError, match="unknown index convention"):
        N.to_half_open(F.lit(1), F.lit(2), "other")


def test_components_subsets_and_layout_errors(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "num long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(7, 8)], "a long, b long")
    got = {r.num: r.root for r in E.components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(6)} | {6: 6, 7: 7, 8: 7}
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "num long, v string")
    assert [r.num for r in E.select_subsets(rows, {"na": {"v": "NA"}, "not_x": {"v": {"not_in": ["x"]}}}, ["na", "not_x"]).collect()] == [2]
    with pytest.raises(ValueError, match="unknown subsets"):
        E.select_subsets(rows, {}, ["other"])
    bad = spark.createDataFrame([(1, 10, 5, 4, 6, 2)], "series_id long, n long, te long, s0 long, s1 long, w long")
    with pytest.raises(Exception, match="bad layout"):
        S.checked(bad).collect()


def test_claims_votes_and_replay(spark):
    a = spark.createDataFrame([("q", "- it rose [a, b]\nnonsense\n- none known [none]")], "answer_id string, answer string")
    got = I.claim_lines(a).orderBy("claim_id").collect()
    assert [(r.claim_id, r.text, r.ids, r.malformed) for r in got] == [("c1", "it rose", ["a", "b"], None), ("c2", None, None, "nonsense"), ("c3", "none known", ["none"], None)]
    rv = spark.createDataFrame([("r1", "A", 9.0), ("r1", "B", 1.0), ("r2", "B", 1.0), ("r3", "B", 1.0)], "reviewer string, target string, credits double")
    assert {r.target: r.score for r in I.quadratic_votes(rv).collect()} == {"A": 3.0, "B": 3.0}
    with pytest.raises(Exception, match="votes for itself"):
        I.quadratic_votes(spark.createDataFrame([("A", "A", 1.0)], rv.schema)).collect()
    b = spark.createDataFrame([(m, "c1", m < 2) for m in range(3)] + [(m, "c2", m < 1) for m in range(3)], "model int, claim_id string, supports boolean")
    assert {r.claim_id: r.passes for r in I.claim_votes(b).collect()} == {"c1": True, "c2": False}
    req = spark.createDataFrame([("k1",), ("k2",)], "key string")
    with pytest.raises(Exception, match="no recording of k2"):
        R.replay(req, spark.createDataFrame([("k1", "v")], "key string, answer string")).collect()
    qs = spark.createDataFrame([("1", "profit growth", None, 1.0), ("2", "hello there", None, 1.0), ("3", "profit", "free", 1.0), ("4", "profit", None, 0.1)], "question_id string, question string, mode string, confidence double")
    cw = spark.createDataFrame([("profit",)], "word string")
    assert {r.question_id: r.route for r in I.route(qs, cw).collect()} == {"1": "grounded", "2": "free", "3": "free", "4": "fallback"}
    sl = I.missing_slots(spark.createDataFrame([(1, "", "x")], "k int, p string, q string"), "k", ["p", "q"]).first()
    assert sl.missing == ["p"]


def test_isolation_forest_and_kmeans_find_a_spike(spark):
    from heronry.operators import forest as O

    rng = np.random.default_rng(3)
    x = np.sin(np.arange(400) * 2 * np.pi / 50) + 0.05 * rng.normal(size=400)
    x[300:305] += 4
    series, lay = make(spark, {1: x}, te=200, s0=300, s1=305, w=10)
    for score in (O.isolation_forest(series, lay, trees=40, group=7), O.kmeans_distance(series, lay)):
        s = score.orderBy("idx").toPandas()
        assert len(s) == 400 and 285 <= int(s.score.idxmax()) <= 315
    a = O.isolation_forest(series, lay, trees=20, group=5).orderBy("idx").toPandas().score
    b = O.isolation_forest(series, lay, trees=20, group=20).orderBy("idx").toPandas().score
    assert np.allclose(a, b)  # the same trees, however they are dealt out
    assert O.expected_path(np.array([1, 2])).tolist() == [0.0, 1.0]


def test_checked_tables(spark):
    from heronry.operators import tables as B

    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, w double")
    assert B.join_checked(left, right, ["k"], validate="m:1").count() == 3
    with pytest.raises(Exception, match="is not unique"):
        B.join_checked(left, right, ["k"]).collect()
    assert B.union_all(left, right).columns == ["k", "v", "w"]
    assert [r.v for r in B.first_rows(left, ["k"], "v").orderBy("k").collect()] == ["a", "b"]
    assert [r.v for r in B.index_with_overflow(left, 2, "v", text="v").collect()] == ["a", "b", "... 1 more"]
    with pytest.raises(Exception, match="several values"):
        B.pivot_strict(left.withColumn("x", F.lit(1.0)).withColumn("c", F.lit("p")), "k", "c", "x", ["p"]).collect()


def test_outlier_ratio_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=130)
    x[50:60] = 1.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series_id long, idx long, x double")
    want = []
    for i in range(130):
        near = x[max(0, i - 5) : i + 6]
        d, off = np.median(np.abs(near - np.median(near))), abs(x[i] - np.median(near))
        want.append(off / d if d > 0 else (np.inf if off > 0 else 0.0))
    for block in (30, 1000):
        got = E.outlier_ratio(df, reach=5, block=block).orderBy("idx").toPandas().ratio
        assert np.allclose(got, want)


def test_deliberation_refinement_and_choices(spark):
    from heronry.operators import lifecycle as L

    rv = spark.createDataFrame([("r1", "A", 4.0), ("r2", "B", 4.0)], "reviewer string, target string, credits double")
    scores, n, done = L.deliberate(rv, lambda r, s, n: r.union(spark.createDataFrame([(f"x{n}", "A", 25.0)], r.schema)), rounds=4, enough=0.7)
    assert (n, done) == (2, True) and {r.target: r.score for r in scores.collect()} == {"A": 7.0, "B": 2.0}
    rows = spark.createDataFrame([(1, 0), (2, 2), (3, 9)], "k int, v int")
    out = L.refine(rows, lambda d: d.where("v > 0"), lambda d, n: d.withColumn("v", F.col("v") - 1), "k", rounds=3)
    assert {r.k: (r.v, r.round) for r in out.collect()} == {1: (0, 0), 2: (0, 2), 3: (6, 3)}
    tasks = spark.createDataFrame([("a", "d1"), ("b", "d2")], "task_key string, default string")
    hist = spark.createDataFrame([("a", "h")], "task_key string, chosen string")
    assert {r.chosen for r in L.choose(tasks, "deterministic").collect()} == {"d1", "d2"}
    with pytest.raises(Exception, match="no recorded choice for b"):
        L.choose(tasks, "replay", history=hist).collect()
    ranked = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "y", 2.0, 2), ("a", "z", 2.0, 3), ("b", "x", None, 1)], "task_key string, ref string, value double, seq int")
    assert L.choose(tasks.where("task_key = 'a'"), "dynamic", ranked=ranked).first().chosen == "y"
    with pytest.raises(Exception, match="cold start"):
        L.choose(tasks, "dynamic", ranked=ranked).collect()
    m = spark.createDataFrame([({"acc": 0.9}, {"acc": 0.8}), ({"acc": 0.9}, {"acc": 0.8, "f1": 0.1})], "m map<string,double>, f map<string,double>")
    assert [r.ok for r in m.select(L.meets_floor(F.col("m"), F.col("f")).alias("ok")).collect()] == [True, False]
    assert L.condition_grid(spark, {"a": [1, 1.0], "b": ["x"]}).count() == 2
    assert [r.sentence for r in L.sentences(spark.createDataFrame([(1, "One. Two!\nThree")], "id int, text string")).orderBy("pos").collect()] == ["One.", "Two!", "Three"]


def test_keyword_counts_are_those_of_str_count(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab "), 60)) for _ in range(40)] + [None, "", "AaA"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    qs = {1: "aa aa ab", 2: "aba b", 3: "zz", 4: " "}
    got = I.keyword_topk(docs, spark.createDataFrame(list(qs.items()), "query_id int, query string"), 4)
    want = set()
    for q, s in qs.items():
        scores = sorted((-sum((t or "").lower().count(w) for w in s.split()), i) for i, t in enumerate(texts))
        want |= {(q, i, -v, k + 1) for k, (v, i) in enumerate([x for x in scores if x[0] < 0][:4])}
    assert {tuple(r) for r in got.collect()} == want


def test_queries_run_the_references_parameters(spark, monkeypatch):
    from heronry.plans import QUERIES, evaluation, extra

    seen, real = {}, extra.O.isolation_forest
    monkeypatch.setattr(extra.O, "isolation_forest", lambda *a, **k: seen.update(k) or real(*a, **k))
    QUERIES["isolation_forest"](spark, "/root/testdata/sf0.001")
    assert seen["trees"] == 200
    coalitions, held = evaluation.X.coalitions, []
    monkeypatch.setattr(evaluation.X, "coalitions", lambda sized, draws: held.append((sized, coalitions(sized, draws))) or held[-1][1])
    QUERIES["kernel_shap"](spark, "/root/testdata/sf0.001")
    (sized, drawn), = held
    k, n = {r.series_id: r.k for r in sized.collect()}, {r.series_id: r["count"] for r in drawn.groupBy("series_id").count().collect()}
    assert n == {i: 2 + (2 * x + 2048 if x > 1 else 0) for i, x in k.items()}


def test_ancestors_of_deep_chains_and_cycles(spark):
    """Chains longer than any fixed number of rounds would reach, and one that isn't a tree."""
    n = 150
    rows = [("t", i, i - 1 if i else None) for i in range(n)] + [("u", i, i // 3 if i else None) for i in range(20)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long")
    up = {}
    for t, i, p in rows:
        up[t, i] = {(t, i, i)} | ({(t, i, a) for _, _, a in up[t, p]} if p is not None else set())
    assert {tuple(r) for r in R.ancestors(spans).collect()} == set.union(*up.values())
    for length in (1, 2, 3, 5):
        ring = spark.createDataFrame([("t", i, (i + 1) % length) for i in range(length)], "trace_id string, span_id long, parent_id long")
        with pytest.raises(ValueError, match="its own ancestor"):
            R.ancestors(ring)


def test_context_reconstruction_takes_each_series_width(spark):
    rng = np.random.default_rng(5)
    xs = {1: rng.normal(size=100), 2: np.round(rng.normal(size=100), 1)}
    for w in (4, 9):
        series, lay = make(spark, xs, w=w)
        out = M.context_reconstruct(series.join(lay, "series_id")).orderBy("idx").toPandas()
        for k, x in xs.items():
            z = lambda v: (v - v.mean()) / v.std() if np.ptp(v) else v * 0
            cost = [round(float(((z(x[j : j + w]) - z(x[45 - w : 45])) ** 2).sum()), 9) for j in range(30 - w - 3 + 1)]
            j = int(np.argmin(cost))
            want = x.copy()
            want[45:48] = x[j + w : j + w + 3] + x[44] - x[j + w - 1]
            assert np.allclose(out[out.series_id == k].masked, want), (w, k)


def test_claim_wording_and_issues(spark):
    said = {"Sales will grow": "projected", "hold the stock": "advisory", "목표 주가 상향": "advisory", "목표주가": "advisory", "개선을 기대": "projected", "Analysts recommend it": None, "expected to grow": None, "지금 사세요": "advisory", "추천합니다": "advisory", "성장할 것으로 본다": "projected", "a goodwill item": None, "BUY now": "advisory", "좋아지겠습니다": "projected"}
    t = spark.createDataFrame([(k,) for k in said], "text string")
    assert {r.text: r.k for r in t.select("text", I.claim_kind(F.col("text")).alias("k")).collect()} == said
    rows = [("a", "x", "advisory", [], "", False), ("b", "buy", "opinion", [], None, False), ("c", "it will rise", "measured", ["s"], "", False), ("d", "rose", "measured", ["s"], "2024", False), ("e", "x", "projected", [], None, False)]
    claims = spark.createDataFrame(rows, "id string, text string, kind string, support array<string>, as_of string, labeled boolean")
    assert sorted(map(tuple, I.claim_audit(claims).collect())) == [("a", "advisory_output"), ("b", "misclassified_advisory"), ("c", "misclassified_projection"), ("c", "missing_as_of"), ("e", "unlabeled_projection")]
    assert "advisory_output" not in {r.issue for r in I.claim_audit(claims, advisory_allowed=True).collect()}


def test_keyword_search_in_blocks(spark):
    docs = {1: "Banana band", 2: "an ANt and ananas", 3: None, 4: "nothing else", 5: "band band"}
    asked = {"q1": "an an", "q2": "band", "q3": "", "q4": "ananas zzz", "q5": "th"}
    count = lambda t, w: (t or "").lower().count(w)
    want = set()
    for q, text in asked.items():
        ws = text.split()
        scores = sorted(((-sum(count(t, w) for w in ws), i) for i, t in docs.items()))
        want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(scores[:2]) if s < 0}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    a = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    for block in (1, 500):
        assert {tuple(r) for r in I.keyword_topk(d, a, 2, block=block).select("query_id", "doc_id", "score", "rn").collect()} == want


def test_ranks_over_ranges(spark):
    from heronry.operators.tables import ranked

    t = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    out = ranked(t, ["v"]).collect()
    assert [r["rank"] for r in sorted(out, key=lambda r: r.v)] == list(range(1000))
