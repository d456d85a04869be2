"""Tables that cut lineage, in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. A session on one machine that names none gets one of its own; any
other must name one. Tables are Parquet, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import atexit
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder that is set where a session on one machine names none.
OWN_DIR = "file:///tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{OWN_DIR}/{sc.applicationId}"
        sc.setCheckpointDir(found)
    return found


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; then the cluster's own clean-up applies
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan in as many partitions as there are cores, at least: a small file may come in one.

    A table with enough of them, and anything whose plan moves rows already, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys to as many partitions as a shuffle has, and as there are cores at least.

    For rows whose work is large and whose bytes are few: left to itself, adaptive execution puts such rows together.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
