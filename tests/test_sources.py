"""Files in, files out."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from heronry.sources import files as S


def put(path, text):
    path.write_bytes(text.encode())
    return path


@pytest.fixture()
def archive(tmp_path):
    d = tmp_path / "archive"
    d.mkdir()
    put(d / "001_UCR_Anomaly_DISTORTED1sddb40_35_52_60.txt", "1.5\r\n2.5\r\n-3e2\r\n")
    put(d / "002_UCR_Anomaly_a_b_c_2_3_3.txt", "  1 2\t3   4 ")
    put(d / "004_UCR_Anomaly_NOISEx_2_3_4.txt", "1\n2\n")
    return d


def test_series_files(spark, archive):
    rows = {(r.filename[:3], r.idx): r.x for r in S.read_series(spark, str(archive)).collect()}
    assert rows[("001", 2)] == -300.0 and rows[("002", 3)] == 4.0 and len(rows) == 9
    inv = {r.filename[:3]: r for r in S.inventory(spark, str(archive)).collect()}
    assert (inv["001"].n_lines, inv["001"].n_tokens, inv["001"].has_crlf, inv["001"].single_line) == (3, 3, True, False)
    assert (inv["002"].has_tab, inv["002"].single_line, inv["002"].n_tokens) == (True, True, 4)
    m = inv["001"].meta
    assert (m.num, m.name, m.variant, m.base_name, m.train_end, m.begin, m.end) == (1, "DISTORTED1sddb40", "DISTORTED", "1sddb40", 35, 52, 60)
    assert inv["002"].meta.name == "a_b_c"
    gaps = S.numbering_gaps(S.inventory(spark, str(archive)), 4).collect()
    assert [(r.num, r.problem) for r in gaps] == [(3, "missing")]
    labels = S.labels_from_name(S.read_series(spark, str(archive))).where("filename LIKE '002%'").orderBy("idx").select("label").collect()
    assert [r.label for r in labels] == [0, 0, 1, 0]
    d = S.describe_labelled(S.labels_from_name(S.read_series(spark, str(archive)))).where("filename LIKE '002%'").first()
    assert (d.n, d.segments, d.min_segment, d["last"]) == (4, 1, 1, 3)


def test_bad_files_raise_or_are_left_out(spark, archive):
    put(archive / "005_UCR_Anomaly_z_1_2_3.txt", "")
    put(archive / "006_UCR_Anomaly_z_1_2_3.txt", "1 x 2")
    assert S.read_series(spark, str(archive), strict=False).select("filename").distinct().count() == 3
    with pytest.raises(Exception, match="empty series file|CAST_INVALID"):
        S.read_series(spark, str(archive)).collect()
    assert S.parse_filename is not None
    assert spark.sql("select 1").select(S.parse_filename(F.lit("readme.txt")).alias("m")).first().m is None


def test_manifest_check(spark, archive):
    inv = S.inventory(spark, str(archive))
    man = inv.where("filename NOT LIKE '004%'").select("filename", F.when(F.col("filename").startswith("001"), F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), "n_tokens").union(spark.createDataFrame([("x.txt", "0", 1)], "filename string, sha256 string, n_tokens long"))
    got = {r.filename[:3]: r.status for r in S.checked_against(inv, man).collect()}
    assert got == {"001": "mismatch", "002": "match", "004": "file_only", "x.t": "manifest_only"}


def test_span_log_and_gold(spark, tmp_path):
    spans = [{"trace_id": "t", "span_id": str(i), "parent_id": None if not i else "0", "started_at": float(i), "ended_at": i + 2.0, "usage": {"input_tokens": i, "output_tokens": 1}, "attributes": {"pattern": "chain"}} for i in range(3)]
    put(tmp_path / "t.jsonl", "\n\n".join(map(json.dumps, spans)))
    got = S.read_spans(spark, str(tmp_path / "t.jsonl"))
    assert got.count() == 3 and got.agg(F.sum("input_tokens")).first()[0] == 3
    put(tmp_path / "g.jsonl", '# note\n\n{"question_id": "q", "question": "?", "required": ["a"], "helpful": ["b"]}\n')
    g = S.read_gold(spark, str(tmp_path / "g.jsonl")).first()
    assert (g.required, g.helpful, g.forbidden) == (["a"], ["b"], [])
    put(tmp_path / "h.jsonl", '{"question_id": "q", "required": ["a"], "forbidden": ["a"]}\n')
    with pytest.raises(Exception, match="requires a forbidden source"):
        S.read_gold(spark, str(tmp_path / "h.jsonl")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456789012, None, True), (2, 2.0, "x", False)], "k int, v double, s string, ok boolean")
    S.write_csv(df, str(tmp_path / "c"), digits=4)
    text = "".join(gzip.open(p).read().decode() for p in (tmp_path / "c").glob("*.gz"))
    assert "NA" in text and "0.1235" in text
    S.append_jsonl(df, str(tmp_path / "ok"), str(tmp_path / "bad"))
    S.append_jsonl(df, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 2 == spark.read.json(str(tmp_path / "bad")).count()
    S.fan_out(df, {str(tmp_path / "p"): "parquet", str(tmp_path / "j"): "json"})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert S.write_missing(df, str(tmp_path / "m"), "k") == 2
    more = df.union(spark.createDataFrame([(3, 1.0, "y", True)], df.schema))
    assert S.write_missing(more, str(tmp_path / "m"), "k") == 1
    assert S.write_missing(more, str(tmp_path / "m"), "k") == 0
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_markdown_table(spark):
    lines = spark.createDataFrame([("| op | v |",), ("|---|---|",), ("| a | 1.5 |",), ("text",), ("| b | 2 |",)], "value string")
    assert [tuple(r) for r in S.table_from_markdown(lines, ["op", "v"]).collect()] == [("a", "1.5"), ("b", "2")]


def test_bundles_hold_what_files_do(spark, tmp_path):
    """The same series as files of their own and in bundles: equal inventories and values; few files are written."""
    rows = spark.createDataFrame([(f"{k:03d}_shop_Anomaly_u{k}_2_3_4.txt", i, None if (k, i) == (3, 2) else f"{k}.{i}") for k in range(40) for i in range(12)], "filename string, idx long, value string")
    S.write_series(rows.withColumnRenamed("value", "x"), str(tmp_path / "files"))
    S.write_bundle(rows, str(tmp_path / "bundles"))
    assert len(list((tmp_path / "bundles").glob("*.parquet"))) <= 4 < len(list((tmp_path / "files").glob("filename=*")))
    one, two = S.inventory(spark, str(tmp_path / "files")).drop("path"), S.inventory(spark, str(tmp_path / "bundles"), bundled=True).drop("path")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() == 40
    one, two = S.read_series(spark, str(tmp_path / "files")).drop("path"), S.read_series(spark, str(tmp_path / "bundles"), bundled=True).drop("path")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() == 479
    S.write_bundle(spark.createDataFrame([("a.csv", i, f"{i}.5,{int(i in (2, 3, 7))}") for i in range(9)], "filename string, idx long, value string"), str(tmp_path / "csv"), header="x,label")
    back = S.read_labelled_csv(spark, str(tmp_path / "csv"), bundled=True)
    assert [(r.idx, r.x, r.label) for r in back.orderBy("idx").collect()] == [(i, i + 0.5, int(i in (2, 3, 7))) for i in range(9)]
    assert [tuple(r) for r in S.one_anomaly(back).collect()] == [("a.csv", 2)]


def test_queries_over_many_series_write_few_files(spark, monkeypatch):
    from heronry.plans import QUERIES

    monkeypatch.setattr(S, "write_series", None)
    for name in ("series_files", "inventory_values", "file_numbering", "labels_from_filename", "one_anomaly_check"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 or name == "file_numbering"
