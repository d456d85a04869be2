"""The corpus pipeline: five stages over ``documents``, each an operator of :mod:`heronry.llm`.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. Stages
work on every row their predecessor kept.

Defined cases, for each stage: an empty table gives an empty table; a null text counts as empty, and the null source is a
source; rows with equal or null ids are taken each by its own text, unless the stage says otherwise; columns beyond those
of ``documents``, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.lines import drop_frequent_lines
from heronry.llm.mixing import mix_sources
from heronry.llm.near_simhash import keep_one_per_group
from heronry.llm.packing import pack
from heronry.llm.quality import keep_good
from heronry.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines over the limit; ``n_chars`` is that of the text that is left.

    A null or empty text has under 20 words and goes.
    """
    return keep_good(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more go; ``n_chars`` is that of the text that is left.

    No row goes; a null text comes back empty; all rows of one id, or of the null id, count as one document.
    """
    return drop_frequent_lines(docs, min_docs=10, min_chars=1).select(*docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words are near-duplicates of each other; of rows equal in id and text one stays; a null id stays only
    where its group has no other.
    """
    return keep_one_per_group(docs, radius=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, in a global random order; a repeated one keeps its id.

    Rows with equal ids are drawn alike, also those with the null id.
    """
    return mix_sources(docs, exponent=0.5, seed=42).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; copies of a document are packed each."""
    return pack(docs, size=2048, end_id=0)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", best_fit_packing)]

#: The fingerprints and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each on a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
