"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best fit. Two tables change from superstep to superstep: the pieces without a place, and the gaps, the
room left in each open sequence. A superstep

1. opens sequences for the pieces that no gap holds: as many as these need at least,
2. range-sorts pieces and gaps together by size, the largest first,
3. sweeps each range: a piece meets its successor, the smallest gap that is large enough and not yet taken. Pieces
   that meet the same gap are told apart by rank: the first gets it, the next gets the next larger one,
4. sweeps over the ranges: pieces a range could not place, by rank, meet the gaps that ranges of larger sizes had
   left, the nearest first. The sweep needs two counts a range; pieces and gaps then join by the number of their match,
5. updates the gaps. A gap that holds any piece left several times takes as many at once.

Supersteps go on while pieces and gaps fill more than one range, which has a fixed size; what is left then is placed one
by one in the task of that range. All tables between supersteps are written. The driver holds a few numbers for each range
and superstep. Joins are by sort: both sides grow with the corpus, so neither is broadcast.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.store import small_batches, written
from heronry.shared import spread

LITTLE = sys.byteorder == "little"

#: Words and word stems whose ids a worker remembers; at this many it starts anew. Results don't depend on it.
REMEMBERED = 600_000

_ENCODERS: dict[str, WordEncoder] = {}
#: Lower-case letters that normalisation leaves as they are and that make one token group when they stand together.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder(dict):
    """Ids of texts, found word by word and remembered.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its words
    one after another. Case is dropped too, and a comma or full stop after a letter is a token of its own, so that most
    words are met again as a stem seen before. A stem of plain letters is one group for the model, which is asked for it
    without the normalising and splitting that leave it as it is; all others take the whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.stems: dict[bytes, bytes] = {}
        self.tails = {t: self._whole(t) for t in (b".", b",")}

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: bytes) -> bytes:
        if stem.isalpha():  # ASCII letters, and they are low
            return array("I", [t.id for t in self.model.tokenize(stem.decode())]).tobytes()
        if _PLAIN(stem.decode()):
            return array("I", [t.id for t in self.model.tokenize(stem.decode("latin-1").translate(self.letters))]).tobytes()
        return self._whole(stem)

    def __missing__(self, word: bytes) -> bytes:
        if b"<|" in word:  # may hold a special token, which is told apart by case
            out = self[word] = self._whole(word)
            return out
        stem = word.lower()
        tail = b""
        if stem[-1:] in self.tails and stem[-2:-1].isalpha():
            tail = self.tails[stem[-1:]]
            stem = stem[:-1]
        out = self.stems.get(stem)
        if out is None:
            out = self.stems[stem] = self._stem(stem)
        out = self[word] = out + tail
        return out

    def encode(self, text: bytes) -> bytes:
        """32-bit ids of a text, in the machine's byte order."""
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.stems) > REMEMBERED:
            self.stems.clear()
        return b"".join(map(self.__getitem__, text.split()))  # bytes: the six ASCII blanks


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cut(path: str | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

        encoder = _encoder(path or public_tokenizers.path("word_bpe_49k.json"))
        end = array("I", [end_id]).tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, stop, data, offsets in B.pieces(batch.column("text")):
                raw, edges = data.tobytes(), offsets.tolist()
                row, start, crc, length = [], [], [], []
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    ids = encoder.encode(raw[a:b]) + end
                    ids = ids if LITTLE else np.frombuffer(ids, ">u4").astype("<u4").tobytes()
                    for k in range(0, len(ids), 4 * size):
                        piece = ids[k : k + 4 * size]
                        row.append(i)
                        start.append(k // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                start, key = np.array(start, np.int64), np.arange(number, number + len(row))
                number += len(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.array(row, np.int64) + at)), pa.array((start // size).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(key)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "key"],
                )

    return run


#: Pieces and gaps of a range, about; where no more are left, one range holds them all and its task finishes the work.
RANGE = 100_000
_LEFT = "kind int, span int, rank long, key long, size long, sequence long, nth int, tokens long"
_NAMES = [c.split()[0] for c in _LEFT.split(", ")]


def sweep_range(sizes: list[int], keys: list[int], sequences: list[int | None], tokens: list[int]) -> tuple[list, list, list]:
    """Matches (key, size, sequence, n-th of its gap), pieces left and gaps left of one range, in order.

    A row with a sequence is a gap that can take ``tokens`` pieces; others are pieces. Rows come by size, the largest
    first, and of equal sizes gaps first: so the latest gap met is the smallest that holds a piece.
    """
    matches, left, stack = [], [], []
    for size, key, sequence, n in zip(sizes, keys, sequences, tokens, strict=True):
        if sequence is not None:
            stack.append([sequence, n, n, size])
        elif stack:
            gap = stack[-1]
            matches.append((key, size, gap[0], gap[2] - gap[1]))
            gap[1] -= 1
            if not gap[1]:
                stack.pop()
        else:
            left.append((key, size))
    return matches, left, [(s, size, m, n - m) for s, m, n, size in reversed(stack)]  # the smallest first


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range: matches (kind 0), pieces left (1) and gaps left (2), the latter two ranked."""
    span = TaskContext.get().partitionId()
    table = [list(c) for c in ((), (), (), ())]
    for batch in batches:
        for held, name in zip(table, ("size", "key", "sequence", "tokens"), strict=True):
            held += batch.column(name).to_pylist()
    matches, left, gaps = sweep_range(*table)
    n = len(matches) + len(left) + len(gaps)
    before = np.cumsum([0, *(g[2] for g in gaps)])[:-1].tolist()
    columns = (
        [0] * len(matches) + [1] * len(left) + [2] * len(gaps),
        [span] * n,
        [None] * len(matches) + list(range(len(left))) + before,
        [m[0] for m in matches] + [x[0] for x in left] + [None] * len(gaps),
        [m[1] for m in matches] + [x[1] for x in left] + [g[1] for g in gaps],
        [m[2] for m in matches] + [None] * len(left) + [g[0] for g in gaps],
        [m[3] for m in matches] + [None] * len(left) + [g[3] for g in gaps],
        [None] * (len(matches) + len(left)) + [g[2] for g in gaps],
    )
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)


def sweep_ranges(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks meet: (range of pieces, first rank, range of gaps, first rank, how many), from (pieces, gaps) left in each range."""
    stack: list[list[int]] = []  # range, first rank not taken, ranks
    out = []
    for span in sorted(counts):
        pieces, gaps = counts[span]
        at = 0
        while at < pieces and stack:
            top = stack[-1]
            n = min(pieces - at, top[2] - top[1])
            out.append((span, at, top[0], top[1], n))
            at += n
            top[1] += n
            if top[1] == top[2]:
                stack.pop()
        if gaps:
            stack.append([span, 0, gaps])
    return out


def _number(meets: list[tuple[int, int, int, int, int]]):
    """Gives each taken place of a gap left the number of its match, and so each piece left, NULL if it has none."""
    table = np.array(meets, np.int64).reshape(-1, 5)
    table = np.column_stack((table, np.cumsum(table[:, 4]) - table[:, 4]))
    of_gaps = table[np.argsort(table[:, 2], kind="stable")]

    def concerned(spans: np.ndarray) -> list[list[int]]:
        """The entries of the ranges of a batch, as pieces or as gaps, each once."""
        found = [t[i:j] for t, c in ((table, 0), (of_gaps, 2)) for s in spans for i, j in [np.searchsorted(t[:, c], (s, s + 1))]]
        return np.unique(np.concatenate(found), axis=0).tolist() if found else []

    names = ["kind", "key", "size", "sequence", "nth", "match"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, span, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "span", "rank"))
            nth, tokens = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("nth", "tokens"))
            alone = kind == 1
            for pieces, p, gaps, g, n, at in concerned(np.unique(span)):
                mine = np.flatnonzero((kind == 1) & (span == pieces) & (rank >= p) & (rank < p + n))
                low = np.maximum(rank, g)
                held = np.where((kind == 2) & (span == gaps), np.minimum(rank + tokens, g + n) - low, 0).clip(min=0)
                theirs = np.repeat(np.arange(len(held)), held)
                place = low[theirs] + np.arange(len(theirs)) - np.repeat(np.cumsum(held) - held, held)
                both = np.concatenate((mine, theirs))
                alone[mine] = False
                if len(both):
                    match = np.concatenate((at + rank[mine] - p, at + place - g))
                    number = np.concatenate((nth[mine], nth[theirs] + place - rank[theirs])).astype(np.int32)
                    took = batch.take(pa.array(both))
                    yield pa.RecordBatch.from_arrays([*(took.column(c) for c in names[:4]), pa.array(number), pa.array(match)], names)
            rest = batch.filter(pa.array(alone))
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names[:5]), pa.nulls(len(rest), pa.int64())], names)

    return run


def _needed(left: DataFrame, least: int, size: int) -> int:
    """How many sequences pieces longer than ``least`` need at least, if no gap holds any of them."""
    over = left.where(F.col("size") > least)
    fit = [F.ceil(F.count(F.when(F.col("size") > size // (k + 1), 1)) / F.lit(k)) for k in (1, 2, 3, 4, 6, 8)]  # of longer ones k fit at most
    return int(over.agg(F.coalesce(F.greatest(F.ceil(F.sum("size") / size), *fit), F.lit(0))).first()[0])


def best_fit(sizes: list[int], rooms: list[tuple[int, int]], size: int, opened: int) -> list[int]:
    """The sequence of each piece (longest first): the smallest room left that holds it, or a new one, numbered from ``opened``.

    ``rooms``: (room, sequence) of the gaps there are.
    """
    held = sorted(rooms)
    out = []
    for n in sizes:
        at = bisect_left(held, (n, -1))
        if at < len(held):
            room, sequence = held.pop(at)
        else:
            room, sequence, opened = size, opened, opened + 1
        out.append(sequence)
        if room > n:
            insort(held, (room - n, sequence))
    return out


def _finish(size: int, opened: int, step: int):
    """Places all pieces left, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[list] = [[], [], []]
        for batch in batches:
            for held, name in zip(table, ("size", "key", "sequence"), strict=True):
                held += batch.column(name).to_pylist()
        pieces = sorted(((n, k) for n, k, s in zip(*table, strict=True) if s is None), key=lambda p: (-p[0], p[1]))
        sequences = best_fit([n for n, _ in pieces], [(n, s) for n, _, s in zip(*table, strict=True) if s is not None], size, opened)
        m = len(pieces)
        columns = [pa.array([k for _, k in pieces], pa.int64()), pa.array([n for n, _ in pieces], pa.int64()), pa.array(sequences, pa.int64()), pa.array([step] * m, pa.int32()), pa.array(range(m), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "size", "sequence", "step", "nth"])

    return run


def place(pieces: DataFrame, size: int) -> DataFrame | None:
    """(key, size, sequence, step, nth) for each row of ``pieces`` (key, size); None if there are none."""
    spark = pieces.sparkSession
    left, gaps = pieces.select("key", "size"), spark.createDataFrame([], "sequence long, room long")
    opened, step, done = 0, 0, []
    room = 0
    n_left, longest = left.agg(F.count(F.lit(1)), F.max("size")).first()
    n_gaps = 0
    while n_left:
        rows = left.select("size", "key", F.lit(None).cast("long").alias("sequence"))
        if n_left + n_gaps <= RANGE:
            rest = rows.unionByName(gaps.select(F.col("room").alias("size"), F.lit(None).cast("long").alias("key"), "sequence"))
            done.append(written(rest.repartition(1).mapInArrow(_finish(size, opened, step), "key long, size long, sequence long, step int, nth int"), "placed"))
            break
        if longest > room:
            new = _needed(left, room, size)
            gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("sequence"), F.lit(size).cast("long").alias("room")))
            opened, n_gaps = opened + new, n_gaps + new
        takes = F.greatest(F.lit(1), F.floor(F.col("room") / F.lit(longest))).cast("long")
        rows = rows.withColumn("tokens", F.lit(1).cast("long")).unionByName(gaps.select(F.col("room").alias("size"), F.lit(None).cast("long").alias("key"), "sequence", takes.alias("tokens")))
        order = [F.col("size").desc(), F.col("sequence").asc_nulls_last(), F.col("key")]
        ranges = 1 + (n_left + n_gaps) // RANGE
        swept = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _LEFT), "swept")
        counts = {r.span: (r.p or 0, r.g or 0) for r in swept.where("kind > 0").groupBy("span").agg(F.count(F.when(F.col("kind") == 1, 1)).alias("p"), F.sum("tokens").alias("g")).collect()}
        meets = sweep_ranges(counts)
        here = swept.where("kind = 0").select("key", "size", "sequence", F.lit(step).alias("step"), "nth")
        left = swept.where("kind = 1").select("key", "size")
        if meets:
            met = written(swept.where("kind > 0").mapInArrow(_number(meets), "kind int, key long, size long, sequence long, nth int, match long"), "met")
            left = met.where("kind = 1 AND match IS NULL").select("key", "size")
            across = met.where("kind = 1 AND match IS NOT NULL").select("key", "size", "match").join(met.where("kind = 2").select("sequence", "nth", "match").hint("merge"), "match")
            here = written(here.unionByName(across.select("key", "size", "sequence", F.lit(step).alias("step"), "nth")), "placed")
        taken = here.groupBy("sequence").agg(F.sum("size").alias("taken"))
        gaps = gaps.join(taken.hint("merge"), "sequence", "left").select("sequence", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room"))
        done.append(here)
        gaps = written(gaps.where("room > 0"), "gaps")
        told = left.select("size", F.lit(None).cast("long").alias("room")).unionByName(gaps.select(F.lit(None).cast("long").alias("size"), "room"))
        n_left, longest, shortest, n_gaps, room = told.agg(F.count("size"), F.max("size"), F.min("size"), F.count("room"), F.coalesce(F.max("room"), F.lit(0))).first()
        if n_left:
            gaps = gaps.where(F.col("room") >= shortest)
        step += 1
    out = None
    for d in done:
        out = d if out is None else out.unionByName(d)
    return out


def pack(docs: DataFrame, *, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece of each row of ``docs``.

    A document's ids end with ``end_id``. One longer than ``size`` is cut into pieces of ``size``; the last may be
    shorter. ``tokenizer`` is a file all workers can open (default: the installed public one).

    Defined cases: a null or empty text has the end id only; rows with equal or null ids are documents of their own;
    an empty table gives an empty table; other columns are left out.

    Texts are tokenised once, where they are read, and only pieces without their ids are written on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = written(spread(narrow).mapInArrow(_cut(tokenizer, size, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, key long"), "pieces")
    placed = place(cut.select("key", F.col("length").alias("size")), size)
    if placed is None:
        return spark.createDataFrame([], f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # a sequence holds ``size`` pieces at most
    offset = F.sum("size").over(Window.partitionBy("sequence").orderBy("step", "nth")) - F.col("size")
    placed = placed.select("key", F.col("sequence").alias("sequence_id"), offset.alias("offset"))
    return cut.join(placed.hint("merge"), "key").drop("key")
