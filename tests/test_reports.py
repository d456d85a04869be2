"""Checks, reports and corpus operators: errors, orders and edge cases that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from heronry.operators import checks as C
from heronry.operators import corpus as K
from heronry.operators import reports as R
from heronry.sources import files as S


def test_scores_that_are_not_ok_are_errors(spark):
    lay = spark.createDataFrame([(1, 3), (2, 2)], "series_id long, n long")
    good = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, 5.0), (2, 1, 5.0)], "series_id long, idx long, score double")
    assert C.validated(good, lay).count() == 5
    assert {tuple(r) for r in C.score_status(good, lay).collect()} == {(1, "ok", False), (2, "ok", True)}
    for bad, why in ((good.where("idx <> 2"), "bad_length"), (good.withColumn("score", F.when(F.col("idx") == 1, float("inf")).otherwise(F.col("score"))), "not_finite"), (good.withColumn("series_id", F.lit(9)), "unknown")):
        with pytest.raises(Exception, match=why):
            C.validated(bad, lay).collect()
    with pytest.raises(Exception, match="constant"):
        C.validated(good, lay, constant="error").collect()


def test_envelopes_slices_and_plans(spark):
    t = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    assert [tuple(r)[2:] for r in C.within_envelope(t, F.col("v") > 1, F.col("v") * 2).orderBy("k").collect()] == [(4.0, "ok"), (None, "out_of_envelope")]
    assert C.within_envelope(t, F.col("v") > 5, F.col("v"), mode="warn").where("output = 2").first().status == "out_of_envelope"
    with pytest.raises(ValueError):
        C.within_envelope(t, F.col("v") > 1, F.col("v"), mode="x")
    with pytest.raises(Exception, match="1 rows, not 2"):
        C.primary_slice(t, F.col("k") == 1, 2).collect()
    assert not C.preflight(t, F.col("v"), 10).where("k = 2").first().admitted
    with pytest.raises(ValueError, match="unknown detector"):
        C.dispatch({}, "x", t, t)
    states = iter([t, t.limit(1)])
    assert not C.same_rows_twice(lambda: next(states))
    fam = spark.createDataFrame([("a", "x"), ("b", "odd")], "entity string, family string")
    with pytest.raises(Exception, match="unknown family"):
        C.family_labels(fam.select("entity"), fam, {"x": "X"}, ["x"]).collect()
    odd = spark.createDataFrame([([1.0, float("nan")], [1.0, 2.0]), ([1.0], [1.0]), ([1.0, 2.0], [1.0]), ([1.0, 2.0], [2.0, 3.0])], "m array<double>, l array<double>")
    assert [r[0] for r in odd.select(C.curve_fault(F.col("m"), F.col("l"))).collect()] == ["not_finite", "too_short", "length", None]


def test_reports_of_nothing_and_of_ties(spark):
    none = spark.createDataFrame([], "g long, k long, v double")
    assert R.nearest_to_quantiles(none, "g", "k", "v", [0.5]).count() == 0
    assert R.decades(none, "v").count() == 0 and R.concordance(none.withColumnRenamed("v", "rank"), ["g"], "k", "rank").count() == 0
    same = spark.createDataFrame([(1, k, 1.0) for k in range(5)], "g long, k long, v double")
    picks = R.nearest_to_quantiles(same, "g", "k", "v", [0.25, 0.5, 0.75]).orderBy("q").collect()
    assert [r.k for r in picks] == [0, 1, 2]
    few = R.nearest_to_quantiles(same.where("k = 0"), "g", "k", "v", [0.25, 0.5]).collect()
    assert [(r.q, r.k) for r in few] == [(0.25, 0)]
    d = spark.createDataFrame([(0.0,), (None,), (-5.0,), (99.0,), (100.0,)], "v double")
    assert {(r.decade, r.n) for r in R.decades(d, "v").collect()} == {(None, 1), (0, 1), (1, 1), (2, 1)}
    w = spark.createDataFrame([(r, i, float(i)) for r in range(3) for i in range(4)], "rater long, item long, rank double").withColumn("g", F.lit(1))
    assert R.concordance(w, ["g"], "rater", "item").first().w == pytest.approx(1.0)


def test_corpus_and_skills(spark):
    log = spark.createDataFrame([(1, "add", "a", "x"), (2, "forget", None, None), (3, "add", "b", "y"), (4, "add", "c", "z"), (5, "remove", "c", None), (6, "add", "b", "y2")], "seq long, op string, doc_id string, text string")
    assert [tuple(r) for r in K.corpus_state(log).collect()] == [("b", "y2")]
    assert {r.doc_id for r in K.corpus_state(log.where("op <> 'forget'")).collect()} == {"a", "b"}
    e = spark.createDataFrame([(1, "register", "s", None), (2, "use", "s", None), (3, "check", "s", False), (4, "use", "s", None), (5, "check", "s", True), (6, "use", "s", None), (7, "deprecate", "s", None), (1, "use", "ghost", None)], "seq long, op string, skill string, ok boolean")
    assert [tuple(r) for r in K.skill_registry(e).collect()] == [("s", "deprecated", 2, True)]
    with pytest.raises(Exception, match="registered twice"):
        K.skill_registry(e.union(spark.createDataFrame([(9, "register", "s", None)], e.schema))).collect()
    nodes = spark.createDataFrame([("t", 1, None, 100), ("t", 2, 1, 500), ("t", 3, 2, 10)], "trace_id string, span_id long, parent_id long, limit long")
    spends = spark.createDataFrame([("t", 3, 30), ("t", 2, 50), ("t", 3, 1)], "trace_id string, span_id long, tokens long")
    out = {r.span_id: (r.depth, r.spent, r.left, r.over, r.too_deep) for r in K.budget_tree(nodes, spends, most_depth=1).collect()}
    assert out == {1: (0, 81, 19, False, False), 2: (1, 81, 19, False, False), 3: (2, 31, -21, True, True)}
    ids = spark.createDataFrame([(["none"], 1), (["none"], 2), (["s", "none"], 1)], "ids array<string>, n long")
    assert [r[0] for r in ids.select(K.abstains(F.col("ids"), F.col("n"))).collect()] == [True, False, False]
    t = spark.createDataFrame([(1, "From the lab. Not this. From the lab.\nsource: x")], "id long, text string")
    assert [tuple(r) for r in K.source_sentences(t, ["^From", "^source"]).orderBy("pos").collect()] == [(1, 0, "From the lab."), (1, 3, "source: x")]


def test_settings_and_anchors(spark, tmp_path):
    got = S.load_config("a:\n  b: 1\n  c:\n    d: [x, 2.5, null]\n# no\ne: 'q: r'\nf:\n  - 1\n  - two # not this\ng: true\n")
    assert got == {"a": {"b": 1, "c": {"d": ["x", 2.5, None]}}, "e": "q: r", "f": [1, "two"], "g": True}
    with pytest.raises(ValueError):
        S.load_config("no key here")
    paths = spark.createDataFrame([("z/__MACOSX/data/a.txt",), ("z/data/a.txt",), ("z/data/._a.txt",)], "path string")
    assert S.anchor(paths, "data").first().folder == "z/data"
    with pytest.raises(Exception, match="2 folders"):
        S.anchor(paths.union(spark.createDataFrame([("y/data/b.txt",)], "path string")), "data").collect()


def test_reasons_features_and_periods(spark):
    from heronry.operators import forest as O
    from heronry.operators import integrity as I

    with pytest.raises(ValueError, match="no reason"):
        I.reasoned({"x": (F.lit(True), 3)}, {"x": " "})
    assert (O.features_used(1, 6), O.features_used(1.0, 6), O.features_used(0.5, 6)) == (1, 6, 3)
    with pytest.raises(ValueError):
        O.features_used(7, 6)
    wave = spark.createDataFrame([(1, i, float(i % 7)) for i in range(80)], "series_id long, idx long, x double")
    assert C.dominant_period(wave, 2, 12).first().period == 7
    lay = spark.createDataFrame([(1, 80, 40, 60, 63, 4)], "series_id long, n long, te long, s0 long, s1 long, w long")
    spiky = wave.withColumn("x", F.when(F.col("idx") == 61, 90.0).otherwise(F.col("x")))
    scores = {}
    for block in (16, 4096):
        for features in (1, 1.0):
            out = O.isolation_forest(spiky, lay, trees=50, max_features=features, block=block).orderBy("idx").toPandas()
            scores[block, repr(features)] = out.score.tolist()
            assert 57 <= int(out.score.idxmax()) <= 63
    assert scores[16, "1"] == pytest.approx(scores[4096, "1"]) and scores[16, "1.0"] == pytest.approx(scores[4096, "1.0"])
    assert scores[16, "1"] != pytest.approx(scores[16, "1.0"])


def test_calls_registries_and_boards(spark):
    from heronry.operators import rollups as L

    assert L.timed(lambda: 3)[:2] == (3, None)
    result, error, seconds = L.timed(lambda: 1 / 0)
    assert result is None and error.startswith("ZeroDivisionError") and seconds >= 0
    reg = spark.createDataFrame([("a", "1", "r", 2), ("a", "2", "r", 6), ("b", "1", "s", 0)], "component string, version string, role string, rung int")
    out = {r.component: tuple(r)[1:] for r in L.registry_report(reg, reg.where("component = 'a'").select("component")).collect()}
    assert out == {"a": ("r", 2, "2", 2, True), "b": ("s", 1, "1", 0, False)}
    with pytest.raises(Exception, match="registered twice"):
        L.registry_report(reg.union(reg.where("component = 'b'")), reg.select("component")).collect()
    cal = spark.createDataFrame([("j", True), ("k", False)], "judge string, usable boolean")
    cases = spark.createDataFrame([(j, 1, True) for j in "jkx"], "judge string, case_id long, passed boolean")
    assert {r.judge: r.verdict for r in L.judged(cases, cal).collect()} == {"j": True, "k": None, "x": None}
    pts = spark.createDataFrame([(1, i, float(i), 3, 2, 4) for i in range(6)], "series_id long, idx long, x double, te long, a long, b long")
    assert [r.masked for r in L.erased(pts.withColumn("masked", F.col("x"))).collect()] == [0, 1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="changed outside"):
        L.erased(pts.withColumn("masked", F.lit(1.0))).collect()
    view = spark.createDataFrame([(1, 2.0)], "key long, value double")
    with pytest.raises(Exception, match="isn't known"):
        L.required_at(view, spark.createDataFrame([(1,), (2,)], "key long")).collect()


def test_residuals_round_as_the_sql_does(spark, tmp_path):
    """5051.50 less 1 %: the two rounded prices lie 0.5 and a little apart by scaled products, 0.5 and less by decimal digits."""
    import duckdb

    from heronry.plans import QUERIES, SQL

    lines = [("A", 1, 1, 5051.5, 0.01, 0.08), ("A", 2, 1, 5064.5, 0.01, 0.08), ("A", 3, 1, 5064.5, 0.01, 0.0), ("A", 4, 1, 100.0, 0.1, 0.08)]
    spark.createDataFrame(lines, "l_returnflag string, l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    names = ["op", "cases", "match_rate", "mismatches", "largest", "q99", "med", "zeros"]
    want = con.execute(SQL["prediction_check"]).fetchall()
    assert [tuple(r) for r in QUERIES["prediction_check"](spark, str(tmp_path)).select(*names).collect()] == want and want[0][3] == 2
    listed = QUERIES["prediction_mismatches"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "more")
    assert [tuple(r) for r in listed.collect()] == con.execute(SQL["prediction_mismatches"]).fetchall() == [(1, 1, 0), (2, 1, 0)]


def test_replicates_move_each_row_once(spark):
    """Rows aren't multiplied by the replicates before they are grouped, and each replicate is the one chosen alone."""
    from heronry.operators import replicates as Y

    rows = spark.range(200).select((F.col("id") % 7).alias("k1"), F.col("id").alias("seq"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("v"))
    got = R.tie_replicates(rows, ["k1"], "seq", 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Generate")  # the deeper a node the later its line
    assert got.columns == ["k", "k1", "seq", "v"] and dict(got.dtypes)["k"] == "int"
    want = [(k, *r) for k in range(5) for r in Y.chosen(rows, ["k1"], "seq", k).select("k1", "seq", "v").collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 35


def test_replicate_summary_moves_each_row_once(spark):
    """The query's lines aren't multiplied by its replicates before they are grouped."""
    from heronry.plans import QUERIES

    plan = QUERIES["replicate_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.rindex("Generate") :].count("Aggregate [") == 2  # that of equal lines, and the choice


def test_replicate_summary_shuffles_its_lines_once(spark):
    """Equal lines and the choice among them need one exchange of lines, by supplier, flag and month."""
    from heronry.plans import QUERIES

    plan = QUERIES["replicate_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.rindex("Generate") :].count("Exchange ") == 1


def test_signs_of_means_go_by_the_order_of_the_file(spark, tmp_path):
    """Effects that cancel out keep what is left of their sum in the rows' order, though the rows of a supplier are in two files."""
    import random
    from datetime import datetime

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from heronry.operators import rollups as U
    from heronry.plans import QUERIES, SQL

    rng = random.Random(3)
    lines = [(unit, (5 + sign * j) / 100) for unit in range(300) for j in range(1, 6) for sign in (-1, 1)]
    rng.shuffle(lines)
    lines[7] = (lines[7][0], None)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    files = [str(tmp_path / "lineitem.parquet" / n) for n in ("a.parquet", "b.parquet")]
    for path, some in zip(files, (lines[:2000], lines[2000:]), strict=True):
        pq.write_table(pa.table({"l_suppkey": [s for s, _ in some], "l_discount": [x for _, x in some], "l_returnflag": ["A"] * len(some), "l_shipdate": [datetime(1995, 1, 1)] * len(some)}), path)
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet({files})")
    got, want = QUERIES["pes_cmi"](spark, str(tmp_path)), con.execute(SQL["pes_cmi"]).fetchdf()
    cell = want.iloc[0].to_dict()
    assert cell["n"] == 300 and min(cell["pos"], cell["neg"], cell["zero"]) > 0 and got.collect()[0].asDict() == cell
    rows = U.in_file_order(spark.read.parquet(str(tmp_path / "lineitem.parquet"))).orderBy("_file", "_row").select("l_suppkey", "l_discount")
    assert [tuple(r) for r in rows.collect()] == lines
