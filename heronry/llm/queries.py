"""Queries of the subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import oracles


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.suffix_trees import drop_repeats

    return drop_repeats(_read(spark, sf_dir, "documents"), depth=20)


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.secret_crf import find_secrets

    return find_secrets(_read(spark, sf_dir, "documents"), sample=20_000)


def op3_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.sparse_suffixes import repeated_passages

    return repeated_passages(_read(spark, sf_dir, "documents"), least=50)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.quality import quality_table

    out = quality_table(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.near_simhash import simhash_components

    out = simhash_components(_read(spark, sf_dir, "documents"), radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.mixing import mix_sources

    out = mix_sources(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "text", F.round("__rate", 6).alias("rate"), F.col("__copy").cast("long").alias("copy"), F.col("__order").alias("order_key"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.lines import drop_frequent_lines

    out = drop_frequent_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.fingerprints import count_near, fingerprint_with_edits
    from heronry.llm.store import written

    out = written(fingerprint_with_edits(_read(spark, sf_dir, "documents")), "fingerprints")
    near = count_near(out.select("doc_id", "fingerprint"), radius=17, every=50)
    return out.join(near.groupBy("doc_id").agg(F.first("n_near").alias("n_near")), "doc_id", "left")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), size=2048, end_id=0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.classifier import score_quality

    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), sample=4000, threshold=0.7)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.phrases import collocations

    return collocations(_read(spark, sf_dir, "documents"), least=30, top=2000)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.turns import repair_report

    return repair_report(_read(spark, sf_dir, "conversations"))


def op13_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.flac import media_digests

    return media_digests(_read(spark, sf_dir, "documents"))


# --- columns of the queries above that SQL can express, by the same operators


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's counts of the fixed patterns."""
    return op2_secret_crf(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's edited texts."""
    from heronry.llm.fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(_read(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13's payloads, read back from their streams."""
    return op13_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    out = dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
    return out | {f.__name__: f for f in (secret_counts, edited_texts, media_payloads)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
