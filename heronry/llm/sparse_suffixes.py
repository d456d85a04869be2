"""Passages that repeat, by sparse suffix arrays.

Only suffixes at minimiser positions (:mod:`anchors`) are retained, about one word in eight. A passage of ``least``
words selects one of them among its first SPAN words, whichever document it stands in, so ``depth`` = least - SPAN + 1
words from there on are the same in all its copies.

1. Suffixes are cut at ``depth`` words, hashed and counted; those that occur once are let go.
2. The others are sorted twice with what stands beside them: by the words to the left, nearest first, and by the words
   to the right. In either order a suffix shares most with a neighbour, so comparing neighbours extends each match as
   far left and right as any copy allows. SPAN - 1 words on either side are enough: a longer match would hold another
   retained suffix, which is extended itself.
   A suffix needs no words to its left if all its holders have the same retained suffix the same way before it: that
   one is extended for all of them. The same holds on the right.
3. Extended matches of a document that touch are one span.

So each span is words that occur elsewhere, every passage of ``least`` words or more that repeats is inside one, and no
span is shorter than ``depth`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm import anchors as A
from heronry.llm import buffers as B
from heronry.llm.store import small_batches, written

#: Words beside a suffix that a match may be extended by.
BESIDE = A.SPAN - 1
_U = np.uint64


def _retained(doc: np.ndarray, hashes: np.ndarray, depth: int) -> tuple[np.ndarray, B.Windows]:
    """Minimiser positions from which ``depth`` words of the document are left."""
    sums = B.Windows(hashes)
    _, chosen = A.minimisers(sums, doc)
    chosen = np.unique(chosen)
    chosen = chosen[chosen + depth <= len(doc)]
    return chosen[doc[chosen + depth - 1] == doc[chosen]], sums


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, end, data, offsets in B.pieces(batch.column("text")):
        starts, ends, doc = B.words(data, offsets)
        yield at, end, doc, B.span_hashes(data, starts, ends)


def _short(key: np.ndarray) -> np.ndarray:
    """48 bits of a suffix: enough to find those that may repeat; whole keys are compared later."""
    return (key >> _U(16)).astype(np.int64)


def _emit(depth: int):
    """Each retained suffix, in short, and its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, doc, hashes in _steps(batch):
                chosen, sums = _retained(doc, hashes, depth)
                own = batch.column("tag").slice(at, end - at).take(pa.array(doc[chosen]))
                yield pa.RecordBatch.from_arrays([pa.array(_short(sums.get(chosen, depth))), own], ["suffix", "tag"])

    return run


def _marks(depth: int):
    """Suffixes of each document that are on its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, doc, hashes in _steps(batch):
                chosen, sums = _retained(doc, hashes, depth)
                key, owner = _short(sums.get(chosen, depth)), doc[chosen]
                edge = np.searchsorted(owner, np.arange(end - at + 1))
                live = np.zeros(len(chosen), bool)
                for a, b, held in zip(edge[:-1], edge[1:], batch.column("suffixes").slice(at, end - at).to_pylist(), strict=True):
                    live[a:b] = np.isin(key[a:b], np.array(held, np.int64))
                chosen, key, owner = chosen[live], key[live], owner[live]
                row = batch.column("row").slice(at, end - at).take(pa.array(owner))
                base = np.searchsorted(doc, np.arange(end - at))
                yield pa.RecordBatch.from_arrays([pa.array(key), row, pa.array((chosen - base[owner]).astype(np.int32))], ["suffix", "row", "pos"])

    return run


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _beside(codes: np.ndarray, doc: np.ndarray, at: np.ndarray, owner: np.ndarray, step: int) -> np.ndarray:
    """24-bit codes of BESIDE words from a position on (step 1) or back (-1), nearest first; 0 outside the document."""
    out = np.zeros((len(at), BESIDE, 3), np.uint8)
    for k in range(BESIDE):
        where = at + k * step
        inside = (where >= 0) & (where < len(codes))
        where = np.clip(where, 0, len(codes) - 1)
        inside &= doc[where] == owner
        out[inside, k] = codes[where[inside]]
    return out


def _with_sides(depth: int):
    """For listed positions: keys of the suffix followed by the words on its left, and on its right, where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, doc, hashes in _steps(batch):
                base = np.searchsorted(doc, np.arange(end - at))
                lists = batch.column("pos").slice(at, end - at)
                owner = np.repeat(np.arange(end - at), lists.value_lengths().to_numpy(zero_copy_only=False))
                pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                chosen = base[owner] + pos
                sums = B.Windows(hashes)
                whole = np.stack([sums.get(chosen, depth, lane) for lane in (0, 1)], axis=1).astype(">u8").view(np.uint8).reshape(len(pos), 16)
                codes = np.maximum(hashes >> _U(40), _U(1)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
                asked = [batch.column(c).slice(at, end - at).flatten() for c in ("l", "r")]
                sides = (_fixed_binary(np.concatenate((whole, _beside(codes, doc, p, owner, s).reshape(len(pos), -1)), axis=1)) for p, s in ((chosen - 1, -1), (chosen + depth, 1)))
                sides = [pc.if_else(wants, keys, pa.scalar(None, pa.binary())) for wants, keys in zip(asked, sides, strict=True)]
                ids = [batch.column(c).slice(at, end - at).take(pa.array(owner)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*sides, *ids, pa.array(pos.astype(np.int32))], ["left", "right", "doc_id", "row", "pos"])

    return run


def shared_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words beside the suffix that rows of keys share, from the suffix on; -1 where the suffixes differ."""
    x, y = (k[:, 16:].reshape(len(k), BESIDE, 3) for k in (a, b))
    same = (x == y).all(axis=2) & x.any(axis=2)
    n = np.where(same.all(axis=1), BESIDE, np.argmin(same, axis=1))
    return np.where((a[:, :16] == b[:, :16]).all(axis=1), n, -1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a sorted group: words shared with the better neighbour, and whose row that is.

    The group's first and last row come with their keys as well (kinds 1 and 2), to meet those of the next groups.
    """
    part = TaskContext.get().partitionId()
    names = ["kind", "part", "key", "doc_id", "row", "pos", "shared", "with_id"]

    def out(kind: int, keys: pa.Array | None, rows: pa.Table | pa.RecordBatch, shared: np.ndarray, with_: pa.Array) -> pa.RecordBatch:
        n = len(rows)
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(x) for x in ("doc_id", "row", "pos"))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), keys if keys is not None else pa.nulls(n, pa.binary()), *cols, pa.array(shared.astype(np.int32)), with_], names)

    held: pa.Table | None = None  # last row so far, with what it shares with the one before
    held_shared, held_with = -1, None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if held is None:
            yield out(1, batch.column("key").slice(0, 1), batch.slice(0, 1), np.array([-1]), pa.nulls(1, batch.column("doc_id").type))
        else:
            table = pa.concat_tables([held, table])
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(len(table), -1)
        step = shared_words(keys[1:], keys[:-1])
        before = np.concatenate(([held_shared], step))
        after = np.append(step, -1)
        ids = table.column("doc_id").combine_chunks()
        better = after > before
        at = np.arange(len(table))
        with_ = ids.take(pa.array(np.where(better, np.minimum(at + 1, len(table) - 1), np.maximum(at - 1, 0))))
        best = np.maximum(before, after)
        if held is not None and not better[0]:
            with_ = pa.concat_arrays([pa.array([held_with], with_.type), with_.slice(1)])
        done = len(table) - 1
        hit = np.flatnonzero(best[:done] >= 0)
        if len(hit):
            yield out(0, None, table.take(pa.array(hit)), best[hit], with_.take(pa.array(hit)))
        held = table.slice(done).combine_chunks()
        held_shared, held_with = int(before[done]), ids[done - 1].as_py() if done else held_with
    if held is not None:
        if held_shared >= 0:
            yield out(0, None, held, np.array([held_shared]), pa.array([held_with], held.column("doc_id").type))
        yield out(2, held.column("key").combine_chunks(), held, np.array([-1]), pa.nulls(1, held.column("doc_id").type))


def _extended(sides: DataFrame, side: str, kind: str) -> DataFrame:
    """(row, doc_id, pos, shared, with_id): what each repeating suffix shares on one side with its best neighbour."""
    spark = sides.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.col("row"), F.col("pos")]
    schema = f"kind int, part int, key binary, doc_id {kind}, row long, pos int, shared int, with_id {kind}"
    rows = sides.select(F.col(side).alias("key"), "doc_id", "row", "pos").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(_neighbours, schema), f"neighbours-{side}")
    columns = ["doc_id", "row", "pos", "shared", "with_id"]
    # the ends of neighbouring groups: two rows a group, each group having rows
    ends = sorted(rows.where("kind > 0").select("part", "kind", "key", "doc_id", "row", "pos").collect(), key=lambda r: (r.part, r.kind))
    met = []
    for x, y in zip(ends[1::2], ends[2::2], strict=False):
        n = int(shared_words(*(np.frombuffer(bytes(e.key), np.uint8)[None] for e in (x, y)))[0])
        if n >= 0:
            met += [(x.doc_id, x.row, x.pos, n, y.doc_id), (y.doc_id, y.row, y.pos, n, x.doc_id)]
    more = spark.createDataFrame(met, f"doc_id {kind}, row long, pos int, shared int, with_id {kind}")
    return rows.where("kind = 0").select(*columns).union(more)


def repeated_passages(docs: DataFrame, *, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, other_doc_id): the spans of each document that occur elsewhere.

    Word positions are of ``[^\\x20\\x09-\\x0D]+``, from 0, the end exclusive. ``other_doc_id`` is a document, or the
    same one, that holds the start of the span too.

    Defined cases: null texts and texts shorter than ``least`` - SPAN + 1 words have no spans; rows of equal id and
    text are one document and don't repeat each other; rows with a null id are told apart by their texts; an empty table
    gives an empty table; other columns are left out.

    Counting combines before its shuffle and the join that follows can be split, so a passage may be in a third of all
    documents. The sorts are by range of key, row and position, which cut such a passage's rows into several groups.
    """
    depth = least - A.SPAN + 1
    if depth < A.GRAM:
        raise ValueError(f"passages of fewer than {A.SPAN + A.GRAM - 1} words select no suffix for certain")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", F.xxhash64("text"))).withColumn("tag", F.shiftright("row", 24))
    kept = base.select("tag", "text").mapInArrow(_emit(depth), "suffix long, tag long")
    # lists of suffixes are tables of their own, so that Spark can split one that many texts hold
    often = written(kept.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("suffix"), "often")
    held = kept.join(often, "suffix", "left_semi").groupBy("tag").agg(F.collect_set("suffix").alias("suffixes"))
    texts = written(base.join(held, "tag").dropDuplicates(["tag", "row"]).select("doc_id", "row", "text", "suffixes"), "open-texts")

    marks = written(texts.select("row", "text", "suffixes").mapInArrow(_marks(depth), "suffix long, row long, pos int"), "marks")
    # rows of one id and text are one by now, so what still repeats is counted anew
    real = written(marks.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("suffix"), "real")
    beside = Window.partitionBy("row").orderBy("pos")
    marks = marks.join(real, "suffix", "left_semi")

    def link(of, sign: int) -> Column:
        """The next suffix of the chain on one side and how far off it is; null at the chain's end."""
        gap = (of("pos").over(beside) - F.col("pos")) * sign
        return F.when(gap <= depth, F.xxhash64(of("suffix").over(beside), gap))

    linked = written(marks.select("suffix", "row", "pos", link(F.lag, -1).alias("before"), link(F.lead, 1).alias("after")), "chains")

    def differs(side: str) -> Column:
        return F.max(F.col(side).isNull()) | (F.min(side) != F.max(side))

    # suffixes whose holders differ in what they chain to
    open_ = written(linked.groupBy("suffix").agg(differs("before").alias("l"), differs("after").alias("r")).where("l OR r"), "open-suffixes")
    wanted = linked.join(open_, "suffix").groupBy("row").agg(F.collect_list("pos").alias("pos"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
    sides = texts.select("doc_id", "row", "text").join(wanted, "row").select("doc_id", "row", "pos", "l", "r", "text").mapInArrow(_with_sides(depth), f"left binary, right binary, doc_id {kind}, row long, pos int")
    sides = written(sides, "sides")
    left, right = (_extended(sides.where(F.col(s).isNotNull()), s, kind).select("row", "doc_id", "pos", (F.col("pos") - F.when(F.lit(s == "left"), F.col("shared")).otherwise(0)).alias("a"), (F.col("pos") + depth + F.when(F.lit(s == "right"), F.col("shared")).otherwise(0)).alias("b"), "with_id") for s in ("left", "right"))
    # each document's extended matches; within a chain the other suffixes only join them
    extended = left.unionByName(right).groupBy("row", "pos").agg(F.first("doc_id").alias("doc_id"), F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("with_id", F.struct("a", -F.col("b"))).alias("with_id"))
    chain = F.sum(F.col("before").isNull().cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, 0))
    chained = linked.select("row", "pos", chain.alias("chain")).join(extended, ["row", "pos"])
    chains = chained.groupBy("row", "chain").agg(F.first("doc_id").alias("doc_id"), F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("with_id", F.struct("a", -F.col("b"))).alias("with_id"))
    lists = chains.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("a", "b", "with_id"))).alias("s"))
    # touching matches become one: fold the sorted list
    start = F.array().cast(f"array<struct<a:int,b:int,with_id:{kind}>>")

    def join(done, x):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"), last["with_id"].alias("with_id"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= x["a"]), grown).otherwise(F.concat(done, F.array(x)))

    merged = lists.select("doc_id", F.explode(F.aggregate("s", start, join)).alias("p"))
    return merged.select("doc_id", F.col("p.a").cast("long").alias("start_word"), F.col("p.b").cast("long").alias("end_word"), (F.col("p.b") - F.col("p.a")).cast("long").alias("n_words"), F.col("p.with_id").alias("other_doc_id"))
