"""Quality rules: word and symbol counts of each text, and the frequency of its lines across documents of its host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.store import small_batches, written
from heronry.shared import spread

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

#: Words of a window in which repetition within a text is measured.
WINDOW = 8

_SCHEMA = "doc_id {id}, host string, k1 long, k2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line split at line feeds; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    docs = np.arange(len(offsets) - 1)
    doc = np.concatenate((docs, owner))
    order = np.argsort(doc, kind="stable")  # a document's own start comes before its line feeds, which are in order
    starts = np.concatenate((offsets[:-1], breaks + 1))[order]
    doc = doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = offsets[doc[last] + 1]
    return starts, ends, doc


def _seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which have an equal anywhere."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return later, any_


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a buffer, and the keys and word counts of its distinct lines with a word."""
    n = len(offsets) - 1
    starts, ends, doc = B.words(data, offsets)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = _per_doc(B.code_points(data) & ~B._SPACE[data], offsets)
    out["n_symbols"] = _per_doc(_IS_SYMBOL[data], offsets)

    ls, le, ld = _lines(data, offsets)
    first, stop = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    full = stop > first
    ls, le, ld, first, stop = (x[full] for x in (ls, le, ld, first, stop))
    by_doc = B.mix(ld.astype(np.uint64) + np.uint64(1))
    later, _ = _seen_before(B.span_hashes(data, ls, le) ^ by_doc)
    out["n_dup_lines"] = np.bincount(ld[later], minlength=n)

    low = B.lower_ascii(data)
    out["line_keys"] = B.span_hashes(low, starts[first], ends[stop - 1]).view(np.int64)
    out["line_words"] = (stop - first).astype(np.int32)
    out["lines"] = np.concatenate(([0], np.cumsum(np.bincount(ld, minlength=n))))

    at = B.whole_windows(doc, WINDOW)
    keys = B.Windows(B.span_hashes(data, starts, ends)).get(at, WINDOW)
    _, again = _seen_before(keys ^ B.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    hit = B.covered(at[again], WINDOW, len(doc))
    out["n_repeat_words"] = np.bincount(doc[hit], minlength=n)
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for batch in batches:
        for at, end, data, offsets in B.pieces(batch.column("text")):
            m = measure(data, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(m["lines"], pa.int32()), pa.array(m[k])) for k in ("line_keys", "line_words")]
            columns = [batch.column(c).slice(at, end - at) for c in ("doc_id", "host", "k1", "k2")] + [pa.array(m[c], pa.int64()) for c in counts] + lists
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "k1", "k2", *counts, "line_keys", "line_words"])


def _content(text_col: str) -> tuple:
    """128 bits that stand for a whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _judged(docs: DataFrame, *, min_docs: int = 10, min_left: float = 0.3, min_words: int = 20, max_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """:func:`quality_table`, and ``bad``: the keys of a text's lines over the limit, or null."""
    small_batches(docs.sparkSession)
    k1, k2 = _content(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    stats = written(spread(narrow).mapInArrow(_measure_batches, _SCHEMA.format(id=kind)), "quality")
    texts = stats.where(F.size("line_keys") > 0).select("host", "k1", "k2", "line_keys", "line_words").dropDuplicates(["host", "k1", "k2"])
    lines = texts.select("host", "k1", "k2", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).groupBy("host", "k1", "k2", F.col("l.line_keys").alias("line")).agg(F.sum("l.line_words").alias("w"))
    lines = written(lines, "quality-lines")
    held = stats.groupBy("host", "k1", "k2").agg((F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("docs"))
    over = lines.join(held, ["host", "k1", "k2"]).groupBy("host", "line").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("host", "line")
    removed = lines.join(over, ["host", "line"]).groupBy("host", "k1", "k2").agg(F.sum("w").alias("n_common_words"), F.collect_set("line").alias("bad"))
    out = stats.drop("line_keys", "line_words").join(removed, ["host", "k1", "k2"], "left")
    common = F.coalesce(F.col("n_common_words"), F.lit(0)).cast("long")
    left = F.col("n_words") - common
    base = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words"))
    depleted = (common > 0) & ((left < min_words) | (left < F.lit(min_left) * F.col("n_words")))
    return out.withColumn("n_common_words", common).withColumn("base_failed", base).withColumn("kept", ~base & ~depleted)


def quality_table(docs: DataFrame, **rules) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, k1, k2, the base counts, n_common_words, base_failed, kept.

    Line frequency: lines are normalised (blanks at the ends stripped, A-Z lowered), hashed, and counted by host over
    distinct documents. A line is over the limit when ``min_docs`` documents of its host or more have it, whatever the
    host's size. Lines over the limit count as removed (:func:`keep_good` removes them); a document of which fewer than
    ``min_words`` words or less than ``min_left`` of the words remain is depleted and rejected. One that loses no line isn't.

    Defined cases: a null text has no words and fails the base rules; the null host is a host; rows with equal ids and
    texts are one document when documents are counted, and so are rows with a null id and equal texts; each row is
    judged by its own text; an empty table gives an empty table; other columns are left out.

    Texts are read once, in Arrow batches; line hashes are written to the shared folder with the counts, and all joins
    after that move hashes only. Counts are sums that combine before each shuffle, so a line, a text or a host may have
    a third of the rows.
    """
    return _judged(docs, **rules).drop("bad")


def _drop_lines(text: str, bad: list[int]) -> str:
    """The text without the lines whose keys are on the list."""
    raw = text.encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    starts, ends, _ = B.words(data, offsets)
    ls, le, _ = _lines(data, offsets)
    first, stop = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    full = np.flatnonzero(stop > first)
    keys = B.span_hashes(B.lower_ascii(data), starts[first[full]], ends[stop[full] - 1]).view(np.int64)
    gone = set(full[np.isin(keys, np.array(bad, np.int64))].tolist())
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def _cleaned(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = batch.column(len(batch.schema) - 1)
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            if bad.null_count < len(bad):
                at = names.index(text_col)
                texts = [t if b is None else _drop_lines(t, b) for t, b in zip(columns[at].to_pylist(), bad.to_pylist(), strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules: float) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_table` keeps, with their own columns and without lines over the limit.

    Verdict and lines depend on host and text alone, so both are joined by hashes of these. Defined cases are those of
    :func:`quality_table`; other columns pass through.
    """
    verdicts = _judged(docs, id_col=id_col, text_col=text_col, host_col=host_col, **rules)
    changed = verdicts.where(~F.col("kept") | F.col("bad").isNotNull()).select(F.col("host").alias("__h"), F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("kept").alias("__kept"), F.col("bad").alias("__bad")).dropDuplicates(["__h", "__a", "__b"])
    a, b = _content(text_col)
    met = docs.join(changed, (F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col("__h")) & (a == F.col("__a")) & (b == F.col("__b")), "left")
    return met.where(F.coalesce("__kept", F.lit(True))).select(*docs.columns, "__bad").mapInArrow(_cleaned(text_col), docs.schema)
