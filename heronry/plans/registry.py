"""Queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _whole_counts(sql: str) -> str:
    """count_if gives 128-bit integers in DuckDB; the same SQL with 64-bit ones."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(sql[at:end] + "::BIGINT")
        at = end
    return "".join([*out, sql[at:]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, directory) under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _whole_counts(sql)
        return f

    return add


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
