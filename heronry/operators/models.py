"""Fitted detectors as tables: fitted once, kept in a folder, and scored later without the training data.

A model lies in ``folder/name/version``; the version is a hash of its kind and settings, so that one with other settings is
another model. Its tables are Parquet; ``settings`` says what it was fitted with. A fit that is there already isn't done again.

Isolation forests keep a row a tree, nodes as arrays. Profiles keep a row a block of reference windows, with the values,
means and deviations of the windows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators import forest as O
from heronry.operators import profile as P
from heronry.operators.series import fit_part, pack
from heronry.shared import dealt

#: Windows of a block: a series of one block meets all its trees in one task.
BLOCK = 4096


def version_of(kind: str, settings: dict) -> str:
    """A hash of kind and settings, whatever their order."""
    return hashlib.sha256(json.dumps([kind, settings], sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Model:
    """Where a fitted detector is, and how it was fitted."""

    kind: str
    path: str
    settings: dict

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _kept(tables: dict[str, DataFrame], kind: str, folder: str, name: str, settings: dict) -> Model:
    """Write the tables of a model; ``settings`` comes last, so that a model is whole when they are there."""
    spark = next(iter(tables.values())).sparkSession
    model = Model(kind, f"{folder}/{name}/{version_of(kind, settings)}", settings)
    if not _there(spark, f"{model.path}/settings"):
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{model.path}/{table}")
        spark.createDataFrame([(kind, json.dumps(settings, sort_keys=True))], "kind string, settings string").write.mode("overwrite").parquet(f"{model.path}/settings")
    return model


def load(spark: SparkSession, folder: str, name: str, kind: str, settings: dict) -> Model:
    """A model that is there; one that isn't whole, or was fitted otherwise, is an error."""
    model = Model(kind, f"{folder}/{name}/{version_of(kind, settings)}", settings)
    if not _there(spark, f"{model.path}/settings"):
        raise ValueError(f"no {kind} model {name!r} with these settings")
    found = model.table(spark, "settings").first()
    if (found.kind, json.loads(found.settings)) != (kind, settings):
        raise ValueError(f"model {name!r} was fitted with {found.settings}")
    return model


def _blocks(series: DataFrame, widths: DataFrame, block: int) -> DataFrame:
    """(series_id, w, first, part) of each block of windows. ``widths``: (series_id, w)."""
    packed = widths.join(pack(series), "series_id").where(F.size("xs") >= F.col("w"))
    first = packed.withColumn("first", F.explode(F.expr(f"sequence(0, size(xs) - int(w), {block})")))
    part = F.slice("xs", F.col("first") + 1, F.least(F.lit(block) + F.col("w").cast("int") - 1, F.size("xs") - F.col("first")))
    return first.select("series_id", "w", "first", part.alias("part"))


def _layout_of(series: DataFrame, widths: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).join(widths, "series_id")


# --- isolation forest

_TREE = "tree int, size long, used array<int>, feature array<int>, cut array<double>, left array<int>, right array<int>, value array<double>"


def fit_forest(series: DataFrame, layouts: DataFrame, folder: str, name: str, *, trees: int = 200, sample: int = 256, max_features: int | float = 1.0, group: int = 25, seed: int = 7) -> Model:
    """Trees over the training windows, those inside [0, te), of each series; dealt out in groups of trees.

    A series without a whole window in training has no trees. The trees are those of
    :func:`heronry.operators.forest.isolation_forest` with the same settings.
    """
    packed = layouts.where("te >= w").select("series_id", "w", "te").join(pack(series), "series_id")
    per = F.when(F.size("xs") - F.col("w") < BLOCK, trees).otherwise(group).alias("per")
    each = packed.withColumn("per", per).withColumn("g", F.explode(F.expr(f"sequence(0, int(ceil({trees} / per)) - 1)")))
    tasks = dealt(each.select("series_id", "w", "g", "per", F.expr("slice(xs, 1, int(te))").alias("train")), "series_id", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                series_id, w, g, count = (batch[c][k].as_py() for c in ("series_id", "w", "g", "per"))
                train = np.lib.stride_tricks.sliding_window_view(batch["train"][k].values.to_numpy(zero_copy_only=False).astype(float), w)
                numbers = range(g * count, min((g + 1) * count, trees))
                yield _tree_rows(O.grow_trees(train, series_id, numbers, sample=sample, max_features=max_features, seed=seed), batch["series_id"][k], w, numbers)

    kind = series.schema["series_id"].dataType.simpleString()
    grown = tasks.mapInArrow(run, f"series_id {kind}, w long, {_TREE}")
    return _kept({"trees": grown}, "forest", folder, name, {"trees": trees, "sample": sample, "max_features": max_features, "seed": seed})


def _tree_rows(t: O.Trees, series_id: pa.Scalar, w: int, numbers: range) -> pa.RecordBatch:
    """A row a tree, with the nodes that its rows reach."""
    count, inner = len(numbers), t.feature >= 0
    there = np.zeros_like(inner)
    there[:, 0] = True
    tree, node = np.nonzero(inner)
    there[tree, t.left[tree, node]] = there[tree, t.left[tree, node] + 1] = True
    place = np.cumsum(there, axis=1) - 1
    left = np.full(t.left.shape, -1)
    left[inner] = place[tree, t.left[inner]]
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    lists = lambda v, kind: pa.ListArray.from_arrays(ends, pa.array(v[there].astype(kind)))
    used = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * t.used.shape[1], pa.array(t.used.ravel().astype(np.int32)))
    columns = [pa.repeat(series_id, count), pa.array(np.full(count, w)), pa.array(np.asarray(numbers, np.int32)), pa.array(np.full(count, t.size)), used]
    columns += [lists(t.feature, np.int32), lists(t.cut, float), lists(left, np.int32), lists(np.where(left >= 0, left + 1, -1), np.int32), lists(t.value, float)]
    return pa.RecordBatch.from_arrays(columns, ["series_id", "w", *(c.split(" ")[0] for c in _TREE.split(", "))])


def _trees_of(r) -> O.Trees:
    """Trees of a row with the arrays of several, one after the other."""
    many = np.asarray(r.nodes)
    tree, place = np.repeat(np.arange(len(many)), many), np.concatenate([np.arange(n) for n in many])

    def filled(values: np.ndarray, empty: float, kind: type) -> np.ndarray:
        out = np.full((len(many), many.max()), empty, kind)
        out[tree, place] = values
        return out

    return O.Trees(int(r.size), np.asarray(r.used).reshape(len(many), -1), filled(r.feature, -1, np.int64), filled(r.cut, 0.0, float), filled(r.left, -1, np.int64), filled(r.value, 0.0, float))


def score_forest(model: Model, series: DataFrame, *, group: int = 25, block: int = BLOCK) -> DataFrame:
    """(series_id, idx, score) of points, by the trees of the model; series without a model have no rows.

    A task has ``group`` trees and a block of windows, all trees where the series is one block.
    """
    spark = series.sparkSession
    trees = model.table(spark, "trees")
    total = model.settings["trees"]
    kind = series.schema["series_id"].dataType.simpleString()
    arrays = ("used", "feature", "cut", "left", "value")
    widths = trees.groupBy("series_id").agg(F.max("w").alias("w"))
    blocks = _blocks(series, widths, block)
    long = blocks.where("first > 0").select("series_id").distinct().withColumn("long", F.lit(True))
    number = F.when(F.col("long"), (F.col("tree") / group).cast("int")).otherwise(0)
    groups = trees.join(long, "series_id", "left").groupBy("series_id", number.alias("g")).agg(F.max("size").alias("size"), F.collect_list(F.struct(*arrays)).alias("t"))
    groups = groups.select("series_id", "g", "size", F.transform("t", lambda t: F.size(t["feature"])).alias("nodes"), *[F.flatten(F.col(f"t.{a}")).alias(a) for a in arrays])
    tasks = dealt(blocks.join(groups, "series_id"), "series_id", "g", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                v = np.lib.stride_tricks.sliding_window_view(np.asarray(r.part, float), int(r.w))
                out.append((r.series_id, np.arange(r.first, r.first + len(v)), _trees_of(r).depths(v), int(r.size)))
            if out:
                yield O.totals_table(out)

    sums = tasks.mapInPandas(run, f"series_id {kind}, start long, total double, size long")
    return O.forest_scores(sums, _layout_of(series, widths), total)


# --- k-means


def fit_kmeans(series: DataFrame, layouts: DataFrame, folder: str, name: str, *, k: int = 4, rounds: int = 20, seed: int = 7) -> Model:
    """Centres of the training windows of each series, with the scale they were found on."""
    return _kept({"centres": O.kmeans_centres(series, layouts, k=k, rounds=rounds, seed=seed)}, "kmeans", folder, name, {"k": k, "rounds": rounds, "seed": seed})


def score_kmeans(model: Model, series: DataFrame, *, block: int = 4096) -> DataFrame:
    """(series_id, idx, score): distance of windows to the nearest centre of the model."""
    centres = model.table(series.sparkSession, "centres")
    return O.centre_distances(_blocks(series, centres.select("series_id", "w"), block), centres, _layout_of(series, centres.select("series_id", "w")), series.schema["series_id"].dataType.simpleString())


# --- matrix profile


def fit_profile(series: DataFrame, layouts: DataFrame, folder: str, name: str, *, kind: str = "z", on: str = "train", block: int = P.BLOCK) -> Model:
    """The training part of each series, or with ``on="full"`` all of it, as blocks of reference windows."""
    parts = _blocks(fit_part(series, layouts, on), layouts.select("series_id", "w"), block)
    v = F.transform(F.sequence(F.lit(1), F.size("part") - F.col("w").cast("int") + 1), lambda i: F.slice("part", i, F.col("w").cast("int")))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    windows = parts.withColumn("v", v).withColumn("mean", F.transform("v", lambda a: add(a) / F.size(a)))
    deviation = F.zip_with("v", "mean", lambda a, mu: F.sqrt(add(F.transform(a, lambda x: (x - mu) * (x - mu))) / F.size(a)))
    reference = windows.select("series_id", "w", F.col("first").cast("long").alias("r0"), F.col("part").alias("ref"), "mean", deviation.alias("sd"))
    return _kept({"reference": reference}, "profile", folder, name, {"kind": kind, "on": on, "block": block})


def score_profile(model: Model, series: DataFrame, *, block: int = P.BLOCK) -> DataFrame:
    """(series_id, start, dist, nearest): every window of the series against the model's reference windows."""
    reference = model.table(series.sparkSession, "reference")
    widths = reference.groupBy("series_id").agg(F.max("w").alias("w"))
    blocks = _blocks(series, widths, block).select("series_id", "w", F.col("first").alias("lo"), F.col("part").alias("q"))
    return P.against(blocks.join(reference.select("series_id", "r0", "ref"), "series_id"), kind=model.settings["kind"], id_type=series.schema["series_id"].dataType.simpleString())
