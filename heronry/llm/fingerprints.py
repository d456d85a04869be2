"""Document fingerprints: 128-bit SimHash of weighted terms, and search by permuted block tables.

Terms are pairs of neighbouring words (A-Z lowered; a text of one word has that word as its term). Each different term
of a text votes with weight 1 + ln(its count) on 128 signed bits; a bit is set where the sum is positive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.store import small_batches, written

BITS = 128
_U = np.uint64
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the documents of a buffer, n x 16 bytes. A text without words has fingerprint zero."""
    n = len(offsets) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    starts, ends, doc = B.words(data, offsets)
    count = np.bincount(doc, minlength=n)
    edge = np.concatenate(([0], np.cumsum(count)))
    sums = B.Windows(B.span_hashes(B.lower_ascii(data), starts, ends))
    for i in np.flatnonzero(count):
        a, b = edge[i], edge[i + 1]
        width = 2 if b - a > 1 else 1
        at = np.arange(a, b - width + 1)
        first, where, tf = np.unique(sums.get(at, width), return_index=True, return_counts=True)
        lanes = np.stack((first, sums.get(at[where], width, 1)), axis=1)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, BITS // 8), axis=1)
        weight = np.rint((1 + np.log(tf)) * 1024)  # whole numbers, so that sums are the same in any order
        out[i] = np.packbits(2 * (weight @ bits.astype(np.float64)) > weight.sum())
    return out


def simhash_texts(texts: list[bytes]) -> np.ndarray:
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))).astype(np.int64)
    return simhash(np.frombuffer(b"".join(texts), np.uint8), offsets)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of fingerprints in rows."""
    return 1 - _ONES[a ^ b].sum(axis=1, dtype=np.int64) / BITS


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many code points from the start of the following one, or all."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _compare(ids: pa.Array, texts: list[str], nexts: list[str], own: np.ndarray, after: np.ndarray, part: int) -> pa.RecordBatch:
    """The rows of texts, given their fingerprints and those of the next ones."""
    new = [edited(t, x).encode() for t, x in zip(texts, nexts, strict=True)]
    other = simhash_texts(new)
    columns = [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in new]),
        pa.array([x.hex() for x in map(bytes, own)], pa.string()),
        pa.array([x.hex() for x in map(bytes, other)], pa.string()),
        pa.array(likeness(own, other)),
        pa.array(likeness(own, after)),
        pa.array(np.full(len(texts), part, np.int32)),
    ]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part"])


_COLUMNS = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the next of its partition; the first and last of the partition come as texts too."""
    part = TaskContext.get().partitionId()
    last: tuple[pa.Array, str, np.ndarray] | None = None

    def bare(kind: int, id_: pa.Array, text: str) -> pa.RecordBatch:
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([id_, *blank, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text])], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "kind", "text"]
    for batch in batches:
        for at, end, data, offsets in B.pieces(batch.column("text")):
            raw, edges = data.tobytes(), offsets.tolist()
            texts = [raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            ids, prints = batch.column("doc_id").slice(at, end - at), simhash(data, offsets)
            if last is None:
                yield bare(1, ids.slice(0, 1), texts[0])
            else:
                ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate((last[2], prints))
            if len(texts) > 1:
                done = _compare(ids.slice(0, len(texts) - 1), texts[:-1], texts[1:], prints[:-1], prints[1:], part)
                yield pa.RecordBatch.from_arrays([*done.columns, pa.array(np.zeros(len(done), np.int32)), pa.nulls(len(done), pa.string())], names)
            last = (ids.slice(len(texts) - 1), texts[-1], prints[-1:])
    if last is not None:
        yield bare(2, last[0], last[1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1)
            text, following = row.column("text").to_pylist(), row.column("following").to_pylist()
            yield _compare(row.column("doc_id"), text, following, *(simhash_texts([x.encode() for x in t]) for t in (text, following)), row.column("part")[0].as_py())


def fingerprint_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next smaller id; after the smallest the largest. Null ids come last and rows
    of equal ids stand in the order of a hash of their texts. A single row is its own next. A null text counts as empty; an empty
    table gives an empty table; other columns are left out.

    Documents are range-partitioned by id and that hash, so an id that many rows share is split and each task sees its documents in order and holds two at a time. What
    crosses a border is the last text of one partition and the first of the next: a row of each for each partition.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    walked = narrow.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    walked = written(walked.mapInArrow(_walk, _COLUMNS.format(id=kind) + ", kind int, text string"), "walk")
    firsts = walked.where("kind = 1").select("part", F.col("text").alias("following"))
    # a row for each partition: its number, that of the next with rows, and the first one's for the last
    chain = firsts.select("part").withColumn("to", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part"))))
    lasts = walked.where("kind = 2").select("doc_id", "text", "part").join(chain, "part").join(firsts.withColumnRenamed("part", "to"), "to")
    ends = lasts.select("doc_id", "text", "following", "part").mapInArrow(_ends, _COLUMNS.format(id=kind))
    return walked.where("kind = 0").drop("kind", "text").unionByName(ends).drop("part")


def _hex_halves(col: Column) -> list[Column]:
    """A hexadecimal fingerprint as two longs."""
    halves = []
    for k in (1, 17):
        high, low = (F.conv(F.substring(col, k + j, 8), 16, 10).cast("long") for j in (0, 8))
        halves.append(F.shiftleft(high, 32).bitwiseOR(low))
    return halves


def _flips(radius: int) -> int:
    """In how many bits a query's block and an entry's may differ: wide radii need wide blocks, which stay selective."""
    return 2 if radius >= 12 else 1


def _blocks(radius: int) -> list[tuple[int, int]]:
    """radius // (flips + 1) + 1 blocks of bits, as even as can be; within the radius one of them differs in no more bits than that."""
    edge = np.linspace(0, BITS, radius // (_flips(radius) + 1) + 2).astype(int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _turned(width: int, flips: int) -> np.ndarray:
    """All ways to turn at most so many of ``width`` bits: ways x width, the first turns none."""
    ways = [()] + [(i,) for i in range(width)] + [(i, j) for i in range(width) for j in range(i) if flips > 1]
    out = np.zeros((len(ways), width), np.uint8)
    for row, way in zip(out, ways, strict=True):
        row[list(way)] = 1
    return out


def _bits(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack((hi, lo), axis=1).astype(">i8").view(np.uint8).reshape(-1, BITS // 8), axis=1)


def _bucket(bits: np.ndarray, t: int) -> np.ndarray:
    """A hash of n x width bits (one block) and of the block's table."""
    padded = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(">u8").astype(_U)
    key = np.full(len(bits), t + 1, _U)
    for k in range(padded.shape[1]):
        key = B.mix(key + B.mix(padded[:, k] + _U(k + 1)))
    return key.view(np.int64)


def _permute(radius: int, probes: bool):
    """A row for each table an entry is in, or, for queries, also for each bucket a few bits of the block away."""
    turned = [_turned(b - a, _flips(radius)) if probes else np.zeros((1, b - a), np.uint8) for a, b in _blocks(radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column("hi").to_numpy(zero_copy_only=False), batch.column("lo").to_numpy(zero_copy_only=False))
            for t, ((a, b), ways) in enumerate(zip(_blocks(radius), turned, strict=True)):
                for at in range(0, len(bits), PAIRS // len(ways)):
                    some = bits[at : at + PAIRS // len(ways), a:b]
                    near = (some[:, None] ^ ways[None]).reshape(-1, b - a)
                    rows = pa.array(np.repeat(np.arange(at, at + len(some)), len(ways)))
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(near, t)), pa.array(np.full(len(near), t, np.int32)), *(batch.column(c).take(rows) for c in ("hi", "lo", "n"))], ["bucket", "t", "hi", "lo", "n"])

    return run


#: Pairs that are compared at once, and entries of a bucket that one task holds.
PAIRS = 500_000
DENSE = 1000


def _scan(radius: int):
    """Rows sorted by bucket and part, entries before queries: for each query the entries it counts."""
    blocks = _blocks(radius)
    names = ("bucket", "part", "q", "t", "hi", "lo", "n")

    def near(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.bitwise_count(rows["hi"][i] ^ rows["hi"][j]).astype(np.int64) + np.bitwise_count(rows["lo"][i] ^ rows["lo"][j])
        hit = apart <= radius
        i, j = i[hit], j[hit]
        if not len(i):
            return i, j
        off = _bits(rows["hi"][i], rows["lo"][i]) ^ _bits(rows["hi"][j], rows["lo"][j])
        meets = np.stack([off[:, a:b].sum(axis=1) <= _flips(radius) for a, b in blocks], axis=1)
        here = np.argmax(meets, axis=1) == rows["t"][i]  # a pair counts in its first table
        return i[here], j[here]

    def found(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        q = rows["q"]
        cut = (rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
        group = np.concatenate(([0], np.cumsum(cut)))
        first = np.append(np.flatnonzero(np.append(True, cut)), len(q))
        asks = np.flatnonzero(q)
        held = np.bincount(group[~q], minlength=len(first) - 1)[group[asks]]
        asks, held = asks[held > 0], held[held > 0]
        count = np.zeros(len(q), np.int64)
        step = np.cumsum(held) // PAIRS
        for a, b in zip(*(np.searchsorted(step, np.unique(step), side) for side in ("left", "right")), strict=True):
            i = np.repeat(asks[a:b], held[a:b])
            at = np.arange(len(i)) - np.repeat(np.cumsum(held[a:b]) - held[a:b], held[a:b])
            i, j = near(rows, i, first[group[i]] + at)
            np.add.at(count, i, rows["n"][j])
        out = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(rows["hi"][out]), pa.array(rows["lo"][out]), pa.array(count[out])], ["hi", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in names}
            if not len(rows["bucket"]):
                continue
            other = np.flatnonzero((rows["bucket"] != rows["bucket"][-1]) | (rows["part"] != rows["part"][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            held = {c: v[last:].copy() for c, v in rows.items()}
            if last:
                yield found({c: v[:last] for c, v in rows.items()})
        if held is not None:
            yield found(held)

    return run


def count_near(prints: DataFrame, *, radius: int = 17, every: int = 50) -> DataFrame:
    """(doc_id, n_near) for rows of ``prints`` (doc_id, fingerprint) whose id is divisible by ``every``.

    ``n_near`` counts the other rows within ``radius`` bits, equal fingerprints included. Fingerprints are dealt to one
    table for each block, permuted to the front: at radius 17 six blocks, of which one at least differs in no more than
    two bits, so a query that looks into its own bucket of each table and into those at most two bits away finds all.
    Copies are one entry with a count. Buckets of more than DENSE entries are dealt out in parts, and their queries go to
    each part.

    Defined cases: null ids are entries but no queries; rows of one id are queries each, by their own fingerprint; an
    empty table gives an empty table.
    """
    hi, lo = _hex_halves(F.col("fingerprint"))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    keyed = prints.select("doc_id", asked.alias("q"), hi.alias("hi"), lo.alias("lo"))
    entries = written(keyed.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("q")), "entries")
    row = "bucket long, t int, hi long, lo long, n long"
    tables = entries.select("hi", "lo", "n").mapInArrow(_permute(radius, False), row)
    probes = entries.where("q").select("hi", "lo", "n").mapInArrow(_permute(radius, True), row)
    dense = written(tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > DENSE).select("bucket", F.ceil(F.col("held") / DENSE).cast("int").alias("parts")), "dense")
    parts = F.coalesce("parts", F.lit(1))
    dealt = tables.join(dense, "bucket", "left").select("bucket", F.pmod(F.xxhash64("hi", "lo"), parts).cast("int").alias("part"), F.lit(False).alias("q"), "t", "hi", "lo", "n")
    asks = probes.join(dense, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("q"), "t", "hi", "lo", "n")
    met = dealt.unionByName(asks).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "q").mapInArrow(_scan(radius), "hi long, lo long, n long")
    # a query's own entry is among those it finds
    counts = met.groupBy("hi", "lo").agg((F.sum("n") - 1).alias("n_near"))
    return keyed.where("q").join(counts, ["hi", "lo"]).select("doc_id", "n_near")
