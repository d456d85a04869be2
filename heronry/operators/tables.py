"""Checked joins, alignment, deduplication and top rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import portable_random
from heronry.shared import written


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows; a key that occurs twice is an error when it is read. The check shares its shuffle with a join on the keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.format_string("key %s is not unique", F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], *, validate: str = "1:1", how: str = "left") -> DataFrame:
    """A join whose keys must be unique on both sides (1:1) or on the right (m:1)."""
    if validate not in ("1:1", "m:1"):
        raise ValueError(f"unknown validation {validate!r}")
    return (unique(left, keys) if validate == "1:1" else left).join(unique(right, keys), list(keys), how)


def align(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each of the wanted keys, NULL where there is no fact; other facts go."""
    return keys.join(facts, keys.columns, "left")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns that a frame lacks NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_rows(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def one_of_each(df: DataFrame, group: str, key: str, *, seed: int = 7) -> DataFrame:
    """A random row of each group: the one with the least seeded hash."""
    return df.withColumn("_h", portable_random(F.lit(seed), F.col(key))).transform(lambda d: first_rows(d, [group], "_h", key)).drop("_h")


def index_with_overflow(df: DataFrame, k: int, *order: str, text: str) -> DataFrame:
    """The first k texts and, if there are more, a row that says how many."""
    n = df.count()
    top = df.orderBy(*order).limit(k).select(text)
    return top.union(df.sparkSession.createDataFrame([(f"... {n - k} more",)], f"{text} string")) if n > k else top


def pivot_strict(df: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Wide form; several values for a cell are an error."""
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit("several values in a cell")).cast("double")).otherwise(F.max(value))
    return df.groupBy(row).pivot(column, list(names)).agg(cell)


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """The rows with their rank (from 0) in the whole order, which should have no ties.

    Rows are range-sorted; a row's rank is its rank in its range plus the rows of earlier ranges. No task sees more than
    a range, and what is summed over one window is one row a range.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range")) - F.col("_n")).alias("_before"))
    local = ranges.withColumn(name, (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).cast("long"))
    return local.join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
