"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.store import written

#: ASCII white space, as in ``[\\x20\\x09-\\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _hash(key: Column) -> Column:
    """128 bits of a key, as two lanes: at 10^12 distinct lines 64 bits would collide."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_frequent_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key, of ``min_chars`` code points or more, is in ``min_docs`` documents or more.

    Returns the columns of ``docs`` with the text cleaned, and before them ``n_lines`` and ``n_dropped`` as
    ``__n_lines`` and ``__n_dropped``. The order of the remaining lines stays.

    Defined cases: a null text counts as one empty line and comes back as an empty text; rows of one id are one
    document when documents are counted, and each keeps its row; rows with a null id count together as one document;
    an empty table gives an empty table; further columns pass through untouched.

    Lines are exploded once, as position and hash of the key; the table is written and read for the counts and for the
    positions to drop. A line that a third of all documents hold is counted by partial sums and met in a join that Spark
    can split. Positions come back by id and text, so rows without an id are spread by their texts. The text is put
    together again from the positions that stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    keys = F.transform(split_lines(F.col("__text")), line_key)
    hashes = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))
    held = narrow.select("__id", F.xxhash64("__text").alias("__t"), F.posexplode(hashes).alias("__pos", "__k")).where("__k IS NOT NULL").select("__id", "__t", "__pos", F.col("__k.a").alias("__a"), F.col("__k.b").alias("__b"))
    held = written(held, "lines")
    common = held.select("__id", "__a", "__b").distinct().groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs).select("__a", "__b")
    bad = held.join(common, ["__a", "__b"]).groupBy("__id", "__t").agg(F.collect_set("__pos").alias("__bad"))
    bad = bad.select(F.col("__id").alias("__i"), F.col("__t").alias("__h"), "__bad")
    out = docs.join(bad, F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64(text) == F.col("__h")), "left")
    lines = split_lines(F.col(text_col))
    # what a lambda refers to is evaluated for each element unless it is an element itself
    once = F.array(F.struct(lines.alias("lines"), F.sequence(F.lit(0), F.size(lines) - 1).alias("places"), F.col("__bad").alias("bad")))
    kept = F.transform(once, lambda s: F.array_join(F.transform(F.array_except(s["places"], s["bad"]), lambda p: F.get(s["lines"], p)), "\n"))
    whole = F.when(F.col("__bad").isNull(), text).otherwise(F.get(kept, 0))
    return out.select(
        F.size(lines).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__bad"), F.lit(0)).cast("long").alias("__n_dropped"),
        *[whole.alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
    )
