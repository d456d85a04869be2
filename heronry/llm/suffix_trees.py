"""Substring dedup over words, by prefix-partitioned suffix trees.

A word window that starts earlier too (in a document of smaller id, or earlier in the same one) is a repeat, and words
that a repeat covers are removed. Suffixes stand in the order of their words, each word a 16-bit symbol, and are read
to REACH words beyond the ``depth`` asked for; 32 bits of the whole window confirm that windows with equal symbols are
equal. A repeat is a leaf, other than the first, below an internal node of ``depth`` words or more.

1. Packs. Documents are packed into rows of some megabytes, compressed, in a table with buckets, so that later steps
   bring their results to the texts and never move texts again.
2. Prefix counts. Each pack tells the prefixes (of PREFIX words) of its suffixes, once each. A suffix whose prefix no
   other pack has is a leaf above ``depth`` in all subtrees but its own pack's, and stays at home.
3. Groups. The remaining suffixes are counted by prefix. A prefix of more than GROUP suffixes is made longer, six bits
   at a time, until each holds fewer; neighbours are then joined up to GROUP. One prefix that can't be cut (a passage in
   very many packs) is dealt out by pack. A group is about GROUP * 64 bytes at any corpus size.
4. Subtrees. A pack sends one suffix, its first, for each different window. A group sorts its suffixes, takes the words
   that neighbours share, and finds the internal nodes from these depths. Leaves but the first go back to their packs.
5. Packs mark their own later copies of each window, add what came back, and cut the covered words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from heronry.llm import buffers as B
from heronry.llm.store import bucketed, small_batches, written
from heronry.shared import spread

#: Bytes of text in a pack; a longer document is a pack of its own.
PACK = 4_000_000
#: Words of the prefixes that are counted first.
PREFIX = 12
#: Words that a sort key holds beyond ``depth``.
REACH = 2
#: Suffixes of a group, at most; each takes about 64 bytes.
GROUP = 1_000_000
#: Prefixes that one task compares at once.
BUCKET = 1_000_000
#: Bits of the first counted prefix, and by how many an overfull one grows.
FIRST_BITS, MORE_BITS = 10, 6
#: Ranges of prefixes whose counts are added up apart.
SLICES = 16

_U = np.uint64
_NO_ID = (1 << 63) - 1


def squeeze(a: np.ndarray, sorted_: bool = False) -> bytes:
    """An integer array in few bytes: differences if sorted, in byte planes, compressed."""
    if sorted_ and len(a):
        a = np.concatenate((a[:1], np.diff(a)))
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), 3)


def stretch(raw: bytes, dtype: type, sorted_: bool = False) -> np.ndarray:
    """The array of :func:`squeeze`."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1)
    a = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(a, dtype=dtype) if sorted_ and len(a) else a


# --- packs


def _pack_up(kind: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, object, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda d: d[:2])
            text = b"".join(d[3] for d in held)
            lengths, ranks, marks = (np.array(x, np.int64) for x in ([len(d[3]) for d in held], [d[0] for d in held], [d[1] for d in held]))
            row = [[number], [[d[2] for d in held]], [zstandard.compress(text, 9)], [squeeze(lengths)], [squeeze(ranks)], [squeeze(marks)], [len(text.split())]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        names = ["pack", "ids", "text", "lengths", "ranks", "marks", "n_words"]
        id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
        types = [pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                if held and size + len(raw) > most:
                    yield flush()
                    number, held, size = number + 1, [], 0
                mark = int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest())
                held.append((_NO_ID if doc_id is None else doc_id, mark, doc_id, raw))
                size += len(raw)
        if held:
            yield flush()

    return run


class Pack:
    """Words of a pack's documents, in the order of (id, mark), and its windows."""

    def __init__(self, row: dict, depth: int) -> None:
        self.row, self.depth = row, depth
        self.raw = zstandard.decompress(row["text"])
        self.lengths, self.ranks, self.marks = (stretch(row[c], np.int64) for c in ("lengths", "ranks", "marks"))
        offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        data = np.frombuffer(self.raw, np.uint8)
        hashes, doc, at, n = [], [], 0, len(self.lengths)
        while at < n:  # texts in steps: what a step holds is several times its bytes
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + B.STEP_BYTES, "right")) - 1)
            piece = data[offsets[at] : offsets[end]]
            s, e, d = B.words(piece, offsets[at : end + 1] - offsets[at])
            hashes.append(B.span_hashes(piece, s, e))
            doc.append(d + at)
            at = end
        self.hashes, self.doc = np.concatenate(hashes), np.concatenate(doc)
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.symbol = (self.hashes >> _U(48)).astype(np.uint16)
        self.symbol[self.symbol == 0] = 1  # 0 is what comes after a document's last word
        self.sums = B.Windows(self.hashes)
        self.at = B.whole_windows(self.doc, depth)

    def prefixes(self, low_bits: int, bucket_bits: int) -> np.ndarray:
        """The prefix of each window: bucket, first symbol, and more bits of its words' hash; 16 + low_bits bits."""
        low = self.sums.get(self.at, min(PREFIX, self.depth)) >> _U(64 - low_bits)
        rest = _U(low_bits - bucket_bits)
        return ((low >> rest) << (rest + _U(16))) | (self.symbol[self.at].astype(_U) << rest) | (low & ((_U(1) << rest) - _U(1)))

    def leaders(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window (index into ``at``) the first equal one of the pack, and whether it is another place.

        Rows of equal id and mark are one document, so the same place in two of them isn't another.
        """
        one, two = self.sums.get(self.at, self.depth), self.sums.get(self.at, self.depth, 1)
        order = np.argsort(one, kind="stable")  # should two windows share 64 bits, copies between them are met in their group
        new = np.ones(len(one), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        lead = np.empty(len(one), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))]
        place = self.at - self.first[self.doc[self.at]]
        d, e = self.doc[self.at], self.doc[self.at[lead]] if len(lead) else lead
        other = (place != place[lead]) | (self.ranks[d] != self.ranks[e]) | (self.marks[d] != self.marks[e]) if len(lead) else np.zeros(0, bool)
        return lead, other

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Sort keys: the symbols of ``depth`` words, 32 bits of the window, and the symbols of REACH more words."""
        p = self.at[windows]
        out = np.empty((len(p), self.depth + 2 + REACH), ">u2")
        for k in range(self.depth):
            out[:, k] = self.symbol[p + k]
        check = self.sums.get(p, self.depth, 1)
        out[:, self.depth], out[:, self.depth + 1] = (check >> _U(48)).astype(np.uint16), ((check >> _U(32)) & _U(0xFFFF)).astype(np.uint16)
        for k in range(REACH):
            q = p + self.depth + k
            inside = q < self.first[self.doc[p] + 1]
            out[:, self.depth + 2 + k] = np.where(inside, self.symbol[np.minimum(q, len(self.symbol) - 1)], 0)
        return out

    def lead_bits(self, windows: np.ndarray) -> np.ndarray:
        """The first four symbols of each window, as one number."""
        p = self.at[windows]
        out = np.zeros(len(p), _U)
        for k in range(4):
            out = (out << _U(16)) | (self.symbol[p + k].astype(_U) if k < self.depth else _U(0))
        return out


def _packs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Pack]:
    for batch in batches:
        for k in range(len(batch)):
            yield Pack(batch.slice(k, 1).to_pylist()[0], depth)


# --- prefix counts


def _tell(depth: int, low_bits: int, bucket_bits: int):
    """Each bucket's different prefixes of each pack, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, depth):
            told = np.unique(pack.prefixes(low_bits, bucket_bits))
            bucket = (told >> _U(16 + low_bits - bucket_bits)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(told)], len(told))
            buckets = bucket[cut[:-1]]
            blobs = [squeeze(told[a:b], True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array([pack.row["pack"]] * len(buckets), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "pack", "told"])

    return run


def _shared(rest: int):
    """For each pack, a bit for each prefix it told: whether another pack told it too. Rows come sorted by bucket.

    Last come counts of such prefixes by the first bits of their first word (pack NULL), to guess which are frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, blobs = None, [], []
        often = np.zeros(1 << FIRST_BITS, np.int64)

        def flush() -> pa.RecordBatch:
            lists = [stretch(b, _U, True) for b in blobs]
            edge = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            told = np.concatenate(lists)
            order = np.argsort(told, kind="stable")
            same = told[order][1:] == told[order][:-1]
            met = np.zeros(len(told), bool)
            met[order[1:]] |= same
            met[order[:-1]] |= same
            symbol = (told[met] >> _U(rest)) & _U(0xFFFF)
            np.add.at(often, (symbol >> _U(16 - FIRST_BITS)).astype(np.int64), 1)
            out = [(p, met[a:b]) for p, a, b in zip(packs, edge[:-1], edge[1:], strict=True)]
            out = [(p, np.packbits(m).tobytes()) for p, m in out if m.any()]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([now] * len(out), pa.int64()), pa.array([zstandard.compress(m) for _, m in out], pa.binary()), pa.nulls(len(out), pa.int64())], names)

        names = ["pack", "bucket", "bits", "n"]

        for batch in batches:
            for bucket, pack, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pack", "told")), strict=True):
                if bucket != now and blobs:
                    yield flush()
                    packs, blobs = [], []
                now = bucket
                packs.append(pack)
                blobs.append(blob)
        if blobs:
            yield flush()
        if often.any():
            cells = np.flatnonzero(often)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.int64()), pa.array(cells), pa.nulls(len(cells), pa.binary()), pa.array(often[cells])], names)

    return run


def _open_windows(pack: Pack, low_bits: int, bucket_bits: int) -> np.ndarray:
    """The pack's first window of each kind whose prefix stands in another pack too."""
    mine = pack.prefixes(low_bits, bucket_bits)
    told, which = np.unique(mine, return_inverse=True)
    bucket = (told >> _U(16 + low_bits - bucket_bits)).astype(np.int64)
    met = np.zeros(len(told), bool)
    for item in pack.row["flags"] or []:
        a, b = np.searchsorted(bucket, [item["bucket"], item["bucket"] + 1])
        met[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(item["bits"]), np.uint8))[: b - a]
    lead, _ = pack.leaders()
    return np.flatnonzero(met[which] & (lead == np.arange(len(lead))))


# --- groups


def _count(depth: int, low_bits: int, bucket_bits: int, bits: int, only: np.ndarray | None, deep: np.ndarray):
    """Suffixes by the first ``bits`` bits of their words, below the prefixes ``only`` (MORE_BITS shorter).

    Below the prefixes ``deep`` (of ``bits``) they are counted by MORE_BITS more at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for pack in _packs(batches, depth):
            lead = pack.lead_bits(_open_windows(pack, low_bits, bucket_bits))
            short = lead >> _U(64 - bits)
            if only is not None:
                mine = np.isin(short >> _U(MORE_BITS), only)
                lead, short = lead[mine], short[mine]
            more = np.isin(short, deep)
            for n_bits, found in ((bits, short[~more]), (bits + MORE_BITS, lead[more] >> _U(64 - bits - MORE_BITS if len(deep) else 0))):
                for p, n in zip(*(x.tolist() for x in np.unique(found, return_counts=True)), strict=True):
                    sums[p, n_bits] = sums.get((p, n_bits), 0) + n
        # one row for each of SLICES ranges of prefixes: a task's counts travel as lists
        prefix, n_bits, n = (np.array(v, t) for v, t in (([p for p, _ in sums], _U), ([b for _, b in sums], np.uint8), (list(sums.values()), np.int64)))
        part = (prefix << (_U(64) - n_bits.astype(_U))) // _U((1 << 64) // SLICES)
        for k in np.unique(part).tolist():
            mine = part == k
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([squeeze(v[mine])], pa.binary()) for v in (prefix, n_bits, n))], ["slice", "prefix", "bits", "n"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks' counts of the slices that this task has."""
    sums: dict[tuple[int, int], int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            for p, b, n in zip(stretch(row["prefix"], _U).tolist(), stretch(row["bits"], np.uint8).tolist(), stretch(row["n"], np.int64).tolist(), strict=True):
                sums[p, b] = sums.get((p, b), 0) + n
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in sums], pa.uint64()).view(pa.int64()), pa.array([b for _, b in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["prefix", "bits", "n"])


def cut_groups(cells: list[tuple[int, int, int]], group: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the groups (64 bits), and into how many parts each is dealt, from (prefix, bits, suffixes)."""
    bounds, parts, held = [], [], 0
    for low, n in sorted((p << (64 - bits), n) for p, bits, n in cells):
        if not bounds or held + n > group:
            bounds.append(low)
            parts.append(1)
            held = 0
        held += n
        parts[-1] = max(1, -(-held // group))
    if bounds:
        bounds[0] = 0
    return np.array(bounds, _U), np.array(parts, np.int64)


def _send(depth: int, low_bits: int, bucket_bits: int, bounds: np.ndarray, parts: np.ndarray):
    """A row for each pack and group: the pack's suffixes of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, depth):
            mine = _open_windows(pack, low_bits, bucket_bits)
            if not len(mine):
                continue
            lead = pack.lead_bits(mine)
            order = np.argsort(lead, kind="stable")
            mine, group = mine[order], np.searchsorted(bounds, lead[order], "right") - 1
            cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            rows = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                w = mine[a:b]
                p = pack.at[w]
                doc = pack.doc[p]
                g = int(group[a])
                rows.append((g, zlib.crc32(b"%d" % pack.row["pack"]) % int(parts[g]), pack.row["pack"], squeeze(pack.keys(w).view(np.uint16).reshape(-1)), squeeze(pack.ranks[doc]), squeeze(pack.marks[doc]), squeeze((p - pack.first[doc]).astype(np.int32)), squeeze(w.astype(np.int32))))
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], ["group", "part", "pack", "keys", "ranks", "marks", "places", "windows"])

    return run


_SENT = "group int, part int, pack long, keys binary, ranks binary, marks binary, places binary, windows binary"


# --- subtrees


def shared_words(keys: np.ndarray, depth: int) -> np.ndarray:
    """Words that each sorted key shares with the one before, for all but the first.

    Keys are ``depth`` symbols, two of the check, and symbols of further words; at a symbol 0 the document ends.
    """
    a, b = keys[:-1], keys[1:]
    same = a == b
    same[:, depth + 2 :] &= a[:, depth + 2 :] > 0
    n = np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1))
    return np.where(n >= depth + 2, n - 2, np.minimum(n, depth - 1))


def outer_nodes(shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, last leaf, depth) of the internal nodes of ``least`` words or more that no other such node holds.

    ``shared`` has -1 for the first leaf. A node is a longest run of leaves whose neighbours share ``least`` words; its
    depth, the least they share, is the length of a repeat that can't be longer to the right in all its places.
    """
    deep = np.concatenate((shared >= least, [False])).astype(np.int8)
    first = np.flatnonzero(np.diff(deep) > 0)
    last = np.flatnonzero(np.diff(deep) < 0)
    return first, last, np.minimum.reduceat(shared, np.stack((first + 1, last + 1), axis=1).reshape(-1).clip(max=len(shared) - 1))[::2] if len(first) else first


def subtree(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and the words each shares with the one before (-1 for the first)."""
    width = keys.shape[1]
    padded = np.zeros((len(keys), -(-width // 4) * 4), ">u2")
    padded[:, :width] = keys
    columns = padded.view(">u8").astype(_U)
    order = np.lexsort(columns.T[::-1])
    return order, np.concatenate(([-1], shared_words(keys[order], depth)))


def _grow(depth: int, split: np.ndarray):
    """Leaves but the first of all nodes of ``depth``; and of groups dealt out in parts, the first leaf of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            get = {c: np.concatenate([stretch(r[c], t) for r in rows]) for c, t in (("ranks", np.int64), ("marks", np.int64), ("places", np.int32), ("windows", np.int32))}
            keys = np.concatenate([stretch(r["keys"], np.uint16).reshape(-1, depth + 2 + REACH).view(">u2") for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(stretch(r["windows"], np.int32)) for r in rows])
            order, shared = subtree(keys, depth)
            first, last, _ = outer_nodes(shared, depth)
            inside = B.covered(first, last - first + 1, len(shared))
            leaves = order[inside]
            node = np.repeat(np.arange(len(first)), last - first + 1)
            by_place = np.lexsort((get["places"][leaves], get["marks"][leaves], get["ranks"][leaves], node))
            head = leaves[by_place[np.searchsorted(node, np.arange(len(first)))]]  # the earliest leaf of each node
            lead = head[node]
            repeats = leaves[(get["ranks"][leaves] != get["ranks"][lead]) | (get["marks"][leaves] != get["marks"][lead]) | (get["places"][leaves] != get["places"][lead])]
            if len(repeats):
                by = np.argsort(owner[repeats], kind="stable")
                repeats = repeats[by]
                cut = np.append(np.flatnonzero(np.append(True, owner[repeats][1:] != owner[repeats][:-1])), len(repeats))
                packs = [rows[owner[repeats[a]]]["pack"] for a in cut[:-1]]
                lists = [squeeze(np.sort(get["windows"][repeats[a:b]]), True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                n = len(packs)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(packs, pa.int64()), pa.array(lists, pa.binary()), *(pa.nulls(n, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)
            if split[now[0]] > 1:
                heads = np.concatenate((head, order[~inside]))
                cols = [pa.array([k.tobytes() for k in keys[heads][:, : depth + 2]], pa.binary()), *(pa.array(get[c][heads]) for c in ("ranks", "marks", "places", "windows"))]
                n = len(heads)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array([rows[o]["pack"] for o in owner[heads]], pa.int64()), pa.nulls(n, pa.binary()), *cols], names)

        names = ["kind", "pack", "list", "key", "rank", "mark", "place", "window"]
        for batch in batches:
            for row in batch.to_pylist():
                if rows and now != (row["group"], row["part"]):
                    yield from flush()
                    rows = []
                now = row["group"], row["part"]
                rows.append(row)
        if rows:
            yield from flush()

    return run


def _one_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [squeeze(np.array([w], np.int32)) for w in batch.column("window").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("pack"), pa.array(lists, pa.binary())], ["pack", "list"])


def _cut(depth: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, depth):
            lead, other = pack.leaders()
            came = np.zeros(len(lead), bool)
            for blob in pack.row["lists"] or []:
                came[stretch(blob, np.int32, True)] = True
            gone = pack.at[other | came[lead]] if len(lead) else pack.at
            covered = B.covered(gone, depth, len(pack.hashes))
            edge = np.concatenate(([0], np.cumsum(pack.lengths))).tolist()
            n, removed, kept = [], [], []
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                ws, off = pack.raw[a:b].split(), covered[pack.first[k] : pack.first[k + 1]]
                n.append(len(ws))
                removed.append(int(off.sum()))
                left = ws if not removed[-1] else [w for w, g in zip(ws, off.tolist(), strict=True) if not g]
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            ids = pa.array(pack.row["ids"], {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def drop_repeats(docs: DataFrame, *, depth: int = 20, pack: int = PACK, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``. Ids are integers.

    Defined cases: a null text has no words; of texts shorter than a window nothing is removed; rows of equal id and
    text are one document, and rows of equal id and different texts stand in the order of a hash; null ids come after
    all others; an empty table gives an empty table; other columns are left out.

    The driver holds the bounds of the groups, one for each ``group`` suffixes.
    """
    spark = docs.sparkSession
    if depth < 4 or not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError("a window has four words at least, and ids are integers")
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packs = bucketed(spread(narrow).mapInArrow(_pack_up(kind, pack), f"pack long, ids array<{kind}>, text binary, lengths binary, ranks binary, marks binary, n_words long"), "packs", "pack", parts)
    total = packs.agg(F.sum("n_words")).first()[0] or 0

    low_bits = min(46, max(16, total.bit_length() + 2))
    bucket_bits = min(low_bits, max((4 * parts - 1).bit_length(), (total // BUCKET).bit_length()))
    told = packs.select("pack", "text", "lengths", "ranks", "marks").mapInArrow(_tell(depth, low_bits, bucket_bits), "bucket long, pack long, told binary")
    shared = told.repartition(max(parts, total // (16 * BUCKET)), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(low_bits - bucket_bits), "pack long, bucket long, bits binary, n long")
    shared = written(shared, "shared")
    flags = shared.where("pack IS NOT NULL").groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    open_ = packs.join(flags.hint("merge"), "pack").select("pack", "text", "lengths", "ranks", "marks", "flags")
    guess = shared.where("pack IS NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    size = min(group, max(1000, sum(r.n for r in guess) // (4 * parts)))  # small tables have smaller groups, so that all tasks have some

    cells: list[tuple[int, int, int]] = []
    only, bits = None, FIRST_BITS
    deep = np.array([r.bucket for r in guess if 2 * r.n > size], np.int64).astype(_U)
    while only is None or len(only):
        counts = open_.mapInArrow(_count(depth, low_bits, bucket_bits, bits, only, deep), "slice int, prefix binary, bits binary, n binary")
        counts = counts.repartition(SLICES, "slice").mapInArrow(_add_up, "prefix long, bits int, n long").collect()
        over = [r for r in counts if r.n > size and r.bits + MORE_BITS <= 64]
        cells += [(r.prefix % (1 << r.bits), r.bits, r.n) for r in counts if not (r.n > size and r.bits + MORE_BITS <= 64)]
        # those counted at once by more bits were twice as long already; shorter ones catch up with them
        bits = max((r.bits for r in over), default=bits) + MORE_BITS
        only = np.array([(r.prefix % (1 << r.bits)) << (bits - MORE_BITS - r.bits) | k for r in over for k in range(1 << (bits - MORE_BITS - r.bits))], _U)
        deep = np.zeros(0, _U)
    bounds, split = cut_groups(cells, size)

    lists = None
    if len(bounds):
        sent = open_.mapInArrow(_send(depth, low_bits, bucket_bits, bounds, split), _SENT)
        grown = sent.repartition(max(parts, int(split.sum()) // 4), "group", "part").sortWithinPartitions("group", "part").mapInArrow(_grow(depth, split), "kind int, pack long, list binary, key binary, rank long, mark long, place int, window int")
        grown = written(grown, "subtrees")
        lists = grown.where("kind = 0").select("pack", "list")
        if (split > 1).any():
            heads = grown.where("kind = 1").select("key", "pack", "rank", "mark", "place", "window")
            least = heads.groupBy("key").agg(F.min(F.struct("rank", "mark", "place")).alias("f"))
            later = heads.join(least, "key").where(F.struct("rank", "mark", "place") != F.col("f")).select("pack", "window")
            lists = lists.unionByName(later.mapInArrow(_one_window, "pack long, list binary"))
        lists = lists.groupBy("pack").agg(F.collect_list("list").alias("lists"))
    back = packs.join(lists.hint("merge"), "pack", "left") if lists is not None else packs.withColumn("lists", F.lit(None).cast("array<binary>"))
    return back.select("ids", "text", "lengths", "ranks", "marks", "lists").mapInArrow(_cut(depth, kind), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
