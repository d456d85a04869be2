"""Replicates that are committed one by one, so that a run that was stopped goes on where it was.

A replicate is written beside its place and renamed into it; then its manifest is written the same way. What has no
manifest isn't there: a later run does it again. Replicate 0 has to equal what is stored, or nothing else is computed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators.models import version_of
from heronry.shared import shared_path

#: Replicates that are chosen in one pass over the rows.
AT_ONCE = 8


class Replicates:
    """The replicates of one folder, of one kind of settings."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict) -> None:
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version_of("replicates", settings)
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.version}/{name}")

    def _renamed(self, name: str, write) -> None:
        """Write beside the place, then take it at once; what an earlier run left there without a manifest goes."""
        beside = f"_{name}-{uuid.uuid4().hex}"
        write(str(self._path(beside)))
        self.fs.delete(self._path(name), True)
        if not self.fs.rename(self._path(beside), self._path(name)):
            raise OSError(f"{name} could not be renamed")

    def manifest(self, k: int) -> dict | None:
        """What was committed of replicate k."""
        at = self._path(f"manifest-{k}")
        if not self.fs.exists(at):
            return None
        return json.loads(self.spark.read.text(str(at)).first().value)

    def done(self) -> list[int]:
        """The replicates that are committed, in order."""
        root = self._path("")
        if not self.fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))

    def commit(self, k: int, rows: DataFrame) -> dict:
        """Write replicate k, and say so."""
        began = time.time()
        self._renamed(f"replicate-{k}", lambda p: rows.write.parquet(p))
        written = self.spark.read.schema(rows.schema).parquet(str(self._path(f"replicate-{k}")))
        said = {"k": k, "version": self.version, "rows": written.count(), "seconds": round(time.time() - began, 3)}
        self._renamed(f"manifest-{k}", lambda p: self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(p))
        return said

    def read(self) -> DataFrame:
        """All committed replicates with their number ``k``."""
        parts = [self.spark.read.parquet(str(self._path(f"replicate-{k}"))).withColumn("k", F.lit(k)) for k in self.done()]
        if not parts:
            raise ValueError("no replicate is committed")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _order(seq: str, k: int, seed: int):
    """What replicate k sorts rows by: the digits of :func:`portable_random`, which sort as their numbers; nothing for 0."""
    return F.lit("") if k == 0 else F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col(seq).cast("string"))), 1, 12)


def chosen(rows: DataFrame, keys: Sequence[str], seq: str, k: int, *, seed: int = 7) -> DataFrame:
    """Of rows that share ``keys`` the one that replicate k takes, by seeded hash; replicate 0 takes the first."""
    return chosen_of_each(rows, keys, seq, [k], seed=seed).drop("k")


def chosen_of_each(rows: DataFrame, keys: Sequence[str], seq: str, ks: Sequence[int], *, seed: int = 7, together: bool = False) -> DataFrame:
    """(k, keys, rest of the row): what each of the replicates ``ks`` takes of rows that share ``keys``.

    Each row moves once, whatever the number of replicates, and before any are chosen: partial groups of few rows would hold
    more than their rows. A group's rows are sorted and streamed by one task, which holds one row for each replicate. Rows that
    share ``keys`` and are ``together`` in a partition stay there.
    """
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    best = (rows if together else rows.repartition(*keys)).groupBy(*keys).agg(*[F.min(F.struct(_order(seq, k, seed).alias("_o"), seq, *rest)).alias(f"_s{k}") for k in ks])
    each = best.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_s{k}").alias("s")) for k in ks])).alias("_e"))
    return each.select("_e.k", *keys, f"_e.s.{seq}", *[f"_e.s.{c}" for c in rest])


def differences(rows: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str], *, relative: float = 1e-14, absolute: float = 1e-15) -> DataFrame:
    """Keys that only one side has, or whose values differ by more than rounding; NULL equals NULL."""
    a = rows.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    b = stored.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        near = F.abs(x - y) <= absolute + relative * F.abs(y) if dict(rows.dtypes)[v] in ("double", "float") else F.lit(False)
        same = same & F.coalesce(x.eqNullSafe(y) | near, F.lit(False))
    return a.join(b, list(keys), "full").where(F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~same).select(*keys)


def run_replicates(rows: DataFrame, keys: Sequence[str], seq: str, folder: str, stored: DataFrame, *, replicates: int = 20, seed: int = 7, stop_after: int | None = None) -> Replicates:
    """Commit replicates 0 to ``replicates`` that aren't there yet; ``stored``: the rows replicate 0 has to equal.

    A replicate 0 that differs is an error, and so is going on with other rows than it was made of: it is compared again
    at each start. Up to ``AT_ONCE`` replicates are chosen in one pass over the rows, kept beside, and committed one by one,
    so a run that is stopped loses one pass at most. ``stop_after`` leaves the rest for a later run.
    """
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in keys]
    held = Replicates(spark, folder, {"keys": list(keys), "seq": seq, "seed": seed, "columns": rows.columns})
    there = set(held.done())
    last = replicates if stop_after is None else min(replicates, stop_after)
    todo = [k for k in range(last + 1) if k == 0 or k not in there]
    for i in range(0, len(todo), AT_ONCE):
        ks = todo[i : i + AT_ONCE]
        beside = shared_path(spark, "chosen")
        chosen_of_each(rows, keys, seq, ks, seed=seed).write.partitionBy("k").parquet(beside)
        for k in ks:
            some = spark.read.schema(rows.schema).parquet(f"{beside}/k={k}") if _has(held, f"{beside}/k={k}") else rows.limit(0)
            if k == 0:
                n = differences(some, stored, keys, values).count()
                if n:
                    raise ValueError(f"replicate 0 differs from what is stored in {n} keys")
            if k not in there:
                held.commit(k, some)
    return held


def _has(held: Replicates, path: str) -> bool:
    return held.fs.exists(held.jvm.org.apache.hadoop.fs.Path(path))
