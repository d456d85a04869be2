"""Tables and Arrow batches of this subpackage, on top of :mod:`heronry.shared`."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from heronry.shared import checkpoint_dir, shared_path, written

__all__ = ["bucketed", "checkpoint_dir", "small_batches", "written"]

#: Rows and bytes that go to Python at once. Texts are long, and a worker holds a few batches of them.
ROWS = 2500
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Hold Arrow batches of this session to ROWS rows and so many bytes; a session that set fewer rows keeps its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS:
        spark.conf.set(key, str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _drop_table(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001 - the session may be gone; then the cluster's own clean-up applies
        pass


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written once to the shared folder, in buckets of ``key``: joins on it move the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", shared_path(spark, name)).saveAsTable(table)
    atexit.register(_drop_table, spark, table)
    return spark.table(table)
