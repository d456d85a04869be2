"""Data sources, keyword index, replicates, principal components."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import components as C
from heronry.operators import integrity as I
from heronry.operators import keyword_index as K
from heronry.operators import replicates as Y
from heronry.operators import reports as R
from heronry.operators import series as S
from heronry.sources import files
from heronry.sources import readers


# --- data sources


@pytest.fixture
def folder(spark, tmp_path):
    names = ["001_x_Anomaly_DISTORTEDab_3_5_6.txt", "002_x_Anomaly_ab_4_5_6.txt", "003_x_Anomaly_NOISEcd_e_3_5_6.txt", "notes.txt"]
    for k, n in enumerate(names):
        (tmp_path / n).write_text(" ".join(str(v + k / 10) for v in range(10 + k)) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    readers.register(spark)
    return tmp_path


def test_series_files(spark, folder):
    got = spark.read.format("series_files").load(str(folder))
    plain = files.read_series(spark, [str(p) for p in folder.glob("*.txt")])
    assert sorted(map(tuple, got.select("filename", "idx", "x").collect())) == sorted(map(tuple, plain.select("filename", "idx", "x").collect()))
    meta = got.where("idx = 0").select("filename", "num", "variant", "base_name", "train_end", "begin", "end")
    want = plain.where("idx = 0").select("filename", files.parse_filename(F.col("filename")).alias("m")).select("filename", "m.num", "m.variant", "m.base_name", "m.train_end", "m.begin", "m.end")
    assert sorted(map(str, meta.collect())) == sorted(map(str, want.collect()))


def test_conditions_choose_files(spark, folder):
    (folder / "900_x_Anomaly_zz_3_5_6.txt").write_text("this is no number")
    some = spark.read.format("series_files").load(str(folder)).where("num = 2 AND variant = 'plain'")
    assert {r.filename for r in some.collect()} == {"002_x_Anomaly_ab_4_5_6.txt"}  # the bad file isn't read
    reader = readers._SeriesReader({"path": str(folder), "taskbytes": "75"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([GreaterThan(("num",), 1), EqualTo(("x",), 1.0)]))
    assert [f.attribute for f in left] == [("x",)] and [i.base_name[:3] for i in reader.chosen()] == ["002", "003", "900"]
    assert [len(p.paths) for p in reader.partitions()] == [1, 2]  # by their bytes
    with pytest.raises(Exception, match="no number"):
        spark.read.format("series_files").load(str(folder)).collect()
    assert spark.read.format("series_files").option("strict", "false").load(str(folder)).where("num = 900").count() == 0


def test_the_sinks_own_files(spark, folder, tmp_path):
    series = spark.createDataFrame([("007_x_Anomaly_q_2_4_5.txt", i, float(i)) for i in range(6)], "filename string, idx long, x double")
    files.write_series(series, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.format("series_files").load(str(tmp_path / "out")).select("filename", "num", "idx", "x").collect())) == [("007_x_Anomaly_q_2_4_5.txt", 7, i, float(i)) for i in range(6)]


def line(i):
    return json.dumps({"trace_id": "t", "span_id": f"s{i}", "started_at": float(i), "name": "näme" * (i % 7)}) + "\n"


def test_span_log_as_table_and_stream(spark, tmp_path):
    readers.register(spark)
    log, state = tmp_path / "log", str(tmp_path / "state")
    log.mkdir()
    (log / "a.jsonl").write_text("".join(line(i) for i in range(50)) + line(50)[:20])
    seen = []

    def run():
        raw = spark.readStream.format("span_log").option("taskBytes", "500").load(str(log))
        q = readers.spans(raw).writeStream.option("checkpointLocation", state).foreachBatch(lambda b, n: seen.extend(r.span_id for r in b.collect())).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert sorted(seen) == sorted(f"s{i}" for i in range(50))  # the line that is being written waits
    table = spark.read.format("span_log").option("taskBytes", "333").load(str(log))
    assert table.count() == 50 and table.rdd.getNumPartitions() > 5
    with (log / "a.jsonl").open("a") as f:
        f.write(line(50)[20:] + line(51))
    (log / "b.jsonl").write_text(line(52) + "\n" + line(53))
    run()
    assert sorted(seen) == sorted(f"s{i}" for i in range(54))


# --- keyword index


def test_index_gives_the_searches_rows(spark, tmp_path):
    rng = random.Random(4)
    words = ["heron", "her", "one", "stone", "aaaa", "É", "x", "Ünder", "the", "a.b", "herring"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, "  "), (502, "one\ttone\nONE")]
    asked = [(1, "her one"), (2, "aa"), (3, "the THE x"), (4, "nothing"), (5, " "), (6, None), (7, "a.b"), (8, "é ünder"), (9, "heronstone")] + [(10 + i, " ".join(rng.choices(words, k=3))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d.write.parquet(str(tmp_path / "docs"))
    q = spark.createDataFrame(asked, "query_id long, query string")
    index = K.index_keywords(spark.read.parquet(str(tmp_path / "docs")), buckets=4, parts=3)
    for p in (tmp_path / "docs").iterdir():
        p.unlink()  # documents are read once
    got = sorted(map(tuple, K.search_index(spark, index, q, 4, parts=3).collect()))
    want = []
    for i, text in asked:
        terms = (text or "").lower().split()
        scored = sorted((-sum((t or "").lower().count(w) for w in terms), k) for k, t in docs)
        want += [(i, k, -s, n + 1) for n, (s, k) in enumerate([x for x in scored if x[0] < 0][:4])]
    assert got == sorted(want)
    assert got == sorted(map(tuple, I.keyword_topk(d, q, 4).select("query_id", "doc_id", "score", "rn").collect()))


def test_search_needs_no_grams_and_goes_by_blocks(spark):
    """Overlaps count once, ties go by id across batches, and blocks of questions give what one gives."""
    docs = spark.createDataFrame([(i, "aaaa heron aaa" if i % 3 else "herons") for i in range(90)] + [(None, "heron"), (200, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, ("aa heron", "aa aa", "her x", "none")[i % 4]) for i in range(12)], "query_id int, query string")
    index = K.index_keywords(docs, buckets=2, parts=2, with_grams=False)
    with pytest.raises(ValueError, match="grams"):
        K.matching_words(spark, index, q.select(F.col("query").alias("term")))
    got = K.search_index(spark, index, q, 3, block=5)
    assert dict(got.dtypes) == {"query_id": "int", "doc_id": "bigint", "score": "bigint", "rn": "bigint"}
    rows = sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[3]))
    want = {0: [(1, 4), (2, 4), (4, 4)], 1: [(1, 6), (2, 6), (4, 6)], 2: [(None, 1), (0, 1), (1, 1)], 3: []}
    assert rows == [(i, d, s, n + 1) for i in range(12) for n, (d, s) in enumerate(want[i % 4])]
    assert rows == sorted(map(tuple, K.search_index(spark, index, q, 3).collect()), key=lambda r: (r[0], r[3]))


# --- replicates


def test_replicates_go_on_after_a_stop(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, i, float(rng.randrange(100))) for k in range(6) for i in range(5)], "k1 long, seq long, v double")
    stored = R.tie_replicates(rows, ["k1"], "seq", 0).drop("k")
    folder = str(tmp_path / "reps")
    first = Y.run_replicates(rows, ["k1"], "seq", folder, stored, replicates=5, stop_after=2)
    assert first.done() == [0, 1, 2] and first.manifest(1)["rows"] == 6 and first.manifest(3) is None
    place = tmp_path / "reps" / first.version
    (place / "replicate-3").mkdir()  # a run that was killed before it said so
    (place / "replicate-3" / "part-x.parquet").write_text("half")
    times = {k: (place / f"replicate-{k}").stat().st_mtime_ns for k in range(3)}
    again = Y.run_replicates(rows, ["k1"], "seq", folder, stored, replicates=5)
    assert again.done() == [0, 1, 2, 3, 4, 5] and times == {k: (place / f"replicate-{k}").stat().st_mtime_ns for k in range(3)}
    got = sorted((r.k, r.k1, r.seq, r.v) for r in again.read().collect())
    assert got == sorted((r.k, r.k1, r.seq, r.v) for r in R.tie_replicates(rows, ["k1"], "seq", 5).collect())
    with pytest.raises(ValueError, match="differs from what is stored in 1"):
        Y.run_replicates(rows, ["k1"], "seq", folder, stored.withColumn("v", F.when(F.col("k1") == 0, -1.0).otherwise(F.col("v"))))
    with pytest.raises(ValueError, match="no replicate"):
        Y.Replicates(spark, str(tmp_path / "none"), {}).read()


def test_replicates_are_chosen_in_few_passes(spark, tmp_path, monkeypatch):
    """Eleven replicates in passes of four; one without rows is committed, too."""
    rows = spark.createDataFrame([(k, i, float(i * k)) for k in range(6) for i in range(5)], "k1 long, seq long, v double")
    passes, old = [], Y.chosen_of_each
    monkeypatch.setattr(Y, "AT_ONCE", 4)
    monkeypatch.setattr(Y, "chosen_of_each", lambda rows, keys, seq, ks, **o: passes.append(list(ks)) or old(rows, keys, seq, ks, **o))
    held = Y.run_replicates(rows, ["k1"], "seq", str(tmp_path / "a"), rows.where("seq = 0"), replicates=10)
    assert passes == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]] and held.done() == list(range(11))
    none = Y.run_replicates(rows.where("k1 > 9"), ["k1"], "seq", str(tmp_path / "b"), rows.where("k1 > 9"), replicates=1)
    assert none.done() == [0, 1] and none.read().count() == 0


# --- principal components


@pytest.mark.parametrize("block", [37, 4096])
def test_components_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    xs = {1: np.sin(np.arange(300) / 5) + 0.1 * rng.normal(size=300) + 100, 2: rng.normal(size=200), 3: np.full(60, 2.0)}
    xs[1][250:255] += 3
    w = 9
    series = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "series_id long, idx long, x double")
    lay = spark.createDataFrame([(k, len(x), len(x) // 2, w) for k, x in xs.items()], "series_id long, n long, te long, w long")
    fitted = C.component_fit(series, lay, share=0.8, block=block)
    got = {(r.series_id, r.idx): r.score for r in C.component_scores(series, fitted, block=block).collect()}
    kept = {r.series_id: r.kept for r in fitted.collect()}
    for k, x in xs.items():
        v = np.lib.stride_tricks.sliding_window_view(x, w)
        train = v[: len(x) // 2 - w + 1]
        mean = train.mean(axis=0)
        _, s, axes = np.linalg.svd(train - mean, full_matrices=False)
        n = 0 if s.max() < 1e-9 else int(np.searchsorted(np.cumsum(s * s) / (s * s).sum(), 0.8)) + 1
        assert kept[k] == n
        rest = v - mean - (v - mean) @ axes[:n].T @ axes[:n]
        want = np.sqrt((rest * rest).sum(axis=1))
        for i in range(len(x)):
            assert got[k, i] == pytest.approx(want[min(max(i - 4, 0), len(v) - 1)], abs=1e-6)
    assert max((i for i in range(300)), key=lambda i: got[1, i]) in range(240, 262)


def test_fit_part(spark):
    series = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "series_id long, idx long, x double")
    lay = spark.createDataFrame([(1, 3)], "series_id long, te long")
    assert S.fit_part(series, lay).count() == 3 and S.fit_part(series, lay, "full").count() == 5
    with pytest.raises(ValueError):
        S.fit_part(series, lay, "half")
