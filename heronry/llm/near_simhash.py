"""SimHash near-duplicates, with pigeonring filtering of candidate pairs.

Fingerprints differ in at most ``radius`` bits when linked. Their 64 bits are cut into radius + 1 segments that stand in
a ring. If the whole ring has at most r differences, then some segment starts a chain of which every prefix of l segments
has at most l * r / (r + 1) of them, that is l - 1 (pigeonring principle). The ring decides who meets: a fingerprint is
filed under the first two segments of the chain from each start, and asks, for each start, under its own two segments and
under those that a chain within budget can hold, with one more difference in the second. Pairs that meet must keep to the
budget of each longer prefix before the full Hamming distance is taken.

A difference is a bit that one of the two has and the other hasn't, so it is enough to ask with one more bit set: the one
that lacks the bit finds the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.components import component_roots, local_roots
from heronry.llm.store import small_batches, written
from heronry.shared import spread

#: Fingerprints of one bucket that a task holds; a bucket with more is dealt out, and its questions go to each part.
BLOCK = 1000
#: Pairs that are compared at once.
PAIRS = 500_000

_U = np.uint64


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of each document: the majority of XXH64 (seed 42) over its shingles, as 8 bytes a row."""
    out = np.zeros((len(offsets) - 1, 8), np.uint8)
    digest = xxhash.xxh64_digest
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        ws = data[a:b].tobytes().lower().split()  # bytes: A-Z only, ASCII blanks only
        if not ws:
            continue
        text = b" ".join(ws)
        if len(ws) <= shingle:
            got = digest(text, 42)
        else:
            ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(ws) - shingle + 1
            got = b"".join([digest(text[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1)
        out[i] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits))
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in B.pieces(batch.column("text")):
            fp = shingle_fingerprints(data, offsets).reshape(-1).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, end - at) for c in ("doc_id", "k1", "k2")] + [pa.array(fp)], ["doc_id", "k1", "k2", "fp"])


def segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment of the ring."""
    edge = np.linspace(0, 64, radius + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def chain_masks(radius: int) -> np.ndarray:
    """The bits of the chain of each length (1 to all segments, second axis) from each start (first axis)."""
    ones = np.array([((1 << n) - 1) << a for a, n in segments(radius)], _U)
    ring = np.stack([np.roll(ones, -k) for k in range(len(ones))])
    return np.bitwise_or.accumulate(ring, axis=1)


def within_chain(diff: np.ndarray, start: np.ndarray, masks: np.ndarray, lengths: range) -> np.ndarray:
    """Indices of the differences whose chain from ``start`` keeps to the budget l - 1 of each length l."""
    at = np.arange(len(diff))
    for n in lengths:
        at = at[np.bitwise_count(diff[at] & masks[start[at], n - 1]) < n]
    return at


def _bucket(first: np.ndarray, second: np.ndarray, start: int) -> np.ndarray:
    """61 bits of two segments and the start's number, which takes the lowest three."""
    key = B.mix(first + B.mix(second + _U(start + 1)))
    return ((key & ~_U(7)) | _U(start)).view(np.int64)


def _file(radius: int, asks: bool):
    """A row for each bucket in which a fingerprint is filed, or in which it asks."""
    ring = segments(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            for start, (a, n) in enumerate(ring):
                low, bits = ring[(start + 1) % len(ring)]
                first, second = (fps >> _U(a)) & _U((1 << n) - 1), (fps >> _U(low)) & _U((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(first, second, start)), pa.array(fps.view(np.int64))], ["bucket", "fp"])
                for k in range(bits if asks and radius else 0):
                    lacks = np.flatnonzero((second >> _U(k)) & _U(1) == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(first[lacks], second[lacks] | _U(1 << k), start)), pa.array(fps[lacks].view(np.int64))], ["bucket", "fp"])

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the same nodes with the same components, no more than nodes."""
    both, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = local_roots(at[: len(u)], at[len(u) :], len(both))
    node = np.flatnonzero(root != np.arange(len(both)))
    return both[node], both[root[node]]


def _meet(radius: int):
    """Rows sorted by bucket, part and kind, those filed before those that ask: links of what meets there.

    A task holds the filed ones of one part and a batch of those that ask.
    """
    masks = chain_masks(radius)
    names = ("bucket", "part", "asks", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in names}
            asks, fps = rows["asks"], rows["fp"].view(_U)
            cut = np.append(True, (rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["part"][1:] != rows["part"][:-1]))
            group, first = np.cumsum(cut) - 1, np.flatnonzero(cut)
            filed = np.bincount(group[~asks], minlength=len(first))
            last = np.flatnonzero((group == group[-1]) & ~asks)
            held = {c: v[last].copy() for c, v in rows.items()}
            who = np.flatnonzero(asks)
            n = filed[group[who]]
            who, n = who[n > 0], n[n > 0]
            step = np.cumsum(n) // PAIRS
            for a, b in zip(*(np.searchsorted(step, np.unique(step), side) for side in ("left", "right")), strict=True):
                i = np.repeat(who[a:b], n[a:b])
                j = first[group[i]] + np.arange(len(i)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                diff = fps[i] ^ fps[j]
                met = within_chain(diff, (rows["bucket"][i] & 7), masks, range(1, radius + 2))  # the last chain is the whole ring
                met = met[diff[met] > 0]
                if len(met):
                    u, v = _forest(fps[i[met]], fps[j[met]])
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def hamming_links(fps: DataFrame, *, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(u, v): links whose components are those of all pairs of distinct ``fp`` values within ``radius`` bits (0 to 7)."""
    if not 0 <= radius <= 7:
        raise ValueError("the radius is 0 to 7")
    filed = fps.select("fp").mapInArrow(_file(radius, False), "bucket long, fp long")
    asking = fps.select("fp").mapInArrow(_file(radius, True), "bucket long, fp long")
    hot = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = written(hot.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot-buckets")
    parts = F.coalesce("parts", F.lit(1))
    filed = filed.join(hot, "bucket", "left").select("bucket", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.lit(False).alias("asks"), "fp")
    asking = asking.join(hot, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "fp")
    dealt = filed.unionByName(asking).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks")
    return dealt.mapInArrow(_meet(radius), "u long, v long").distinct()


def simhash_components(docs: DataFrame, *, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, fp, component_id, class_fp) for each row of ``docs``.

    ``fp`` is the fingerprint as a signed long; ``k1, k2`` are 128 bits of the text; ``component_id`` is the smallest
    id that links reach, itself included; ``class_fp`` names the component also where all its ids are null.

    Defined cases: null, empty and blank texts have fingerprint zero and link like any other; rows with equal ids each
    keep a row; null ids take part in links but never become a component's id, which is null if no other id is in it;
    an empty table gives an empty table.

    Fingerprints are written once. Copies fall together before any pairing, so links are between different
    fingerprints; a hot fingerprint is met only in joins that Spark can split.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), *_content(text_col), F.col(text_col).cast("string").alias("text"))
    prints = written(spread(narrow).mapInArrow(_fingerprint_batches, f"doc_id {kind}, k1 long, k2 long, fp long"), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = component_roots(written(hamming_links(distinct, radius=radius), "links"), "simhash-stars")
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class_fp", F.coalesce("root", "fp"))
    least = labelled.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    names = labelled.select("fp", "class_fp").join(least, "class_fp")
    return prints.join(names, "fp", "left").select("doc_id", "k1", "k2", "fp", "component_id", "class_fp")


def keep_one_per_group(docs: DataFrame, *, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the one with the smallest id.

    Among rows that share that id, or in a group with null ids only, the least hash of the text decides, and of rows
    equal in both one stays.
    """
    members = simhash_components(docs, radius=radius, id_col=id_col, text_col=text_col)
    best = members.groupBy("class_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("__id"), F.col("b.k1").alias("__a"), F.col("b.k2").alias("__b"))
    k1, k2 = _content(text_col)
    out = docs.withColumns({"__k1": k1, "__k2": k2}).join(best, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")), "left_semi")
    return out.dropDuplicates([id_col, "__k1", "__k2"]).select(*docs.columns)


def _content(text_col: str) -> tuple:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
