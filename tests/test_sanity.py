"""Checks of masked profiles: they hold, and a broken profile is told."""

import numpy as np
import pytest

from heronry.operators import profile as P
from heronry.operators import sanity as Y

W, N, TE = 6, 120, 50


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    xs = {1: rng.normal(size=N), 2: np.where(np.arange(N) % 30 < 9, 1.0, rng.normal(size=N))}
    series = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "series_id long, idx long, x double").cache()
    lay = "series_id long, n long, te long, s0 long, s1 long, w long, a long, b long"
    make = lambda size: spark.createDataFrame([(k, N, TE, 100, 104, W, 70, 70 + size) for k in xs], lay)
    return xs, series, make


def test_flat_windows(data):
    xs, series, make = data
    got = {r.series_id: r.flats for r in Y.flat_windows(series, make(W)).collect()}
    assert got == {k: sum(np.ptp(x[i : i + W]) == 0 for i in range(TE - W + 1)) for k, x in xs.items()} and got[2] > 0


def test_fills(data):
    _, series, make = data
    got = {(r.check, r.op): (r.cases, r.match_rate, r.stop) for r in Y.fill_checks(series, make(W)).collect()}
    want = {(c, op): (1, 1.0, False) for op in Y.CONSTANT for c in ("root", "response", "flat")} | {("copy", "recon_train"): (2, 1.0, False)}
    assert got == want
    with pytest.raises(Exception, match="isn't as long"):
        Y.fill_checks(series, make(W + 1)).collect()


def test_rules_hold_and_a_wrong_profile_breaks_them(data, monkeypatch):
    _, series, make = data
    rows = {r.rule: (r.cases, r.failed, r.passes) for r in Y.profile_assertions(series, make(W + 3)).collect()}
    assert rows == {r: (2, 0, True) for r in ("untouched", "incremental", "one_value", "told_apart", "same_mean")}
    right = P.incremental
    monkeypatch.setattr(P, "incremental", lambda *a, **k: right(*a, **k).selectExpr("series_id", "start", "dist + 0.001 * start AS dist", "nearest"))
    rows = {r.rule: r.failed for r in Y.profile_assertions(series, make(W + 3)).collect()}
    assert rows["incremental"] == 2 and rows["one_value"] == 2 and rows["untouched"] == 0
    monkeypatch.undo()
    monkeypatch.setattr(P, "incremental", lambda *a, **k: right(*a, **k).selectExpr("series_id", "start", "dist * 1.01 AS dist", "nearest"))
    bad = {(r.check, r.op): r.stop for r in Y.fill_checks(series, make(W), ops=("zero",)).collect()}
    assert bad[("root", "zero")] and not bad[("flat", "zero")]
