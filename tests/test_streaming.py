"""Streams give what a batch gives."""

import json

from pyspark.sql import functions as F

from heronry.streaming import streams as T


def spans_dir(tmp_path, n=200):
    d = tmp_path / "spans"
    d.mkdir()
    for k in range(4):
        rows = [{"trace_id": f"t{i % 5}", "span_id": str(i), "name": "n", "kind": "model" if i % 3 else "human", "started_at": 1.7e9 + 37.0 * i, "absorbed_tokens": i} for i in range(k * n // 4, (k + 1) * n // 4)]
        (d / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    return str(d)


def test_windowed_counts_and_sessions(spark, tmp_path):
    d = spans_dir(tmp_path)
    batch = spark.read.schema(T.SPAN_SCHEMA).json(d).withColumn("ts", F.timestamp_seconds("started_at"))
    want = {(r.w.start, r.kind): r.n for r in batch.groupBy(F.window("ts", "10 minutes").alias("w"), "kind").agg(F.count("*").alias("n")).collect()}
    out = T.run_available(T.windowed_counts(T.stream_spans(spark, d), ["kind"], value="absorbed_tokens"), "w1", mode="complete")
    assert {(r.start, r.kind): r.n for r in out.collect()} == want
    slide = T.run_available(T.windowed_counts(T.stream_spans(spark, d), [], window="10 minutes", slide="5 minutes"), "w2", mode="complete")
    assert slide.agg(F.sum("n")).first()[0] == 400
    s = T.run_available(T.sessions(T.stream_spans(spark, d), "trace_id", gap="100 seconds"), "w3", mode="complete")
    assert s.agg(F.sum("n")).first()[0] == 200 and s.count() == 200
    dd = T.run_available(T.deduplicated(T.stream_spans(spark, d), ["trace_id"]), "w4")
    assert dd.count() == 5


def test_memory_state(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    first = [("s", "a", "1", 1, at(0), "put", None), ("s", "a", "2", 2, at(1), "put", None), ("s", "b", "x", 3, at(2), "put", None), ("s", "b", None, 4, at(3), "forget", None), ("s", "c", "y", 5, at(4), "put", 60.0)]
    later = [("z", "a", "9", 6, at(600), "put", None)]
    schema = "subject string, key string, value string, seq long, ts string, op string, ttl_seconds double"
    for k, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        log = spark.readStream.schema(schema).json(f"{tmp_path}/log").withColumn("ts", F.to_timestamp("ts"))
        q = T.memory_state(log).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(60), "still running"
    out = {(r.subject, r.key, r.value, r.alive) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {("s", "a", "2", True), ("s", "b", None, False), ("s", "c", "y", True), ("s", "c", "y", False), ("z", "a", "9", True)}


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/rows"
    for batch_id, n in ((0, 3), (1, 2), (1, 2)):  # the second time as after a restart: a new function
        T.write_batch(path)(spark.range(n), batch_id)
    assert spark.read.parquet(path).count() == 5
    empty = spark.createDataFrame([], "trace_id string, ts timestamp, n long")
    empty.write.parquet(f"{tmp_path}/none")
    stream = spark.readStream.schema(empty.schema).parquet(f"{tmp_path}/none")
    assert T.run_available(stream, "none").columns == empty.columns


def test_streams_join_within_a_time(spark, tmp_path):
    schema = "k string, ts string, v long"
    for name, rows in (("left", [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 01:00:00", 2), ("b", "2024-01-01 00:00:00", 3)]), ("right", [("a", "2024-01-01 00:05:00", 10), ("b", "2024-01-01 05:00:00", 20)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema(schema).json(f"{tmp_path}/{name}").withColumn("ts", F.to_timestamp("ts"))
    right = read("right").select(F.col("k").alias("k2"), F.col("ts").alias("ts2"), F.col("v").alias("v2"))
    out = T.joined(read("left"), right, F.expr("k = k2 AND ts2 >= ts AND ts2 <= ts + INTERVAL 10 MINUTES"))
    assert [(r.v, r.v2) for r in T.run_available(out, "joined").collect()] == [(1, 10)]
