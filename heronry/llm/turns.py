"""Conversations brought into the form ``(s?(ua)+)?`` of roles by the cheapest edits.

A conversation is a chain of layers, one for each row and one behind the last. A layer has four nodes, for what stands
before it: nothing, a system row, a user row, an assistant row. Arcs are edits: keep (0), rerole (2) and delete (3) lead
to the next layer, insert (2) stays in its own, and a truncated row that isn't deleted costs 1 more. Costs are small
whole numbers, so Dial's circular buckets give all distances to the end in linear time. The audit then walks from the
start along tight arcs, always the one with the least letter; a letter leads to one node only, so no two cheapest
repairs share an audit.

Rows are ordered by range sort and cut into chunks of ``CHUNK``; a task group is a chunk, at any length of a
conversation. Distances and walks through a chunk depend on four numbers at its end and one node at its start. For
conversations of more than one chunk, these come from chunk tables that are folded from the end and from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.lines import BLANKS
from heronry.llm.store import small_batches, written
from heronry.operators.tables import ranked

#: Rows of a conversation that one task group handles.
CHUNK = 4096
#: What ends a sentence.
END = "[.!?]"

#: Nodes of a layer: nothing, system, user, assistant before it. User may follow all but user.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 40
#: Edits in the order of their letters.
DELETE, INSERT, KEEP, REROLE = "DIKR"
_COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
_BUCKETS = max(_COST.values()) + 2  # an edit's cost is 3 at most, of a truncated row too

#: A row's code: what its role begins with (0 other, 1 system, 2 user, 3 assistant), 4 if truncated, 8 if it has to go.
_KEEPS = {START: {1: SYSTEM, 2: USER}, SYSTEM: {2: USER}, USER: {3: ASSISTANT}, ASSISTANT: {2: USER}}
TRUNCATED, GOES = 4, 8


def arcs(node: int, code: int | None) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows forward, node) of the edits at a node before a row with this code, or before the end."""
    if code is not None:
        yield DELETE, _COST[DELETE], 1, node
    yield INSERT, _COST[INSERT], 0, _NEXT[node]
    if code is not None and not code & GOES:
        more = 1 if code & TRUNCATED else 0
        kept = _KEEPS[node].get(code & 3)
        if kept is not None:
            yield KEEP, _COST[KEEP] + more, 1, kept
        yield REROLE, _COST[REROLE] + more, 1, _NEXT[node]


#: All arcs by code and node, and the same turned round: (cost, rows back, node) that lead to a node.
_ARCS = {c: [list(arcs(s, c)) for s in range(4)] for c in [None, *range(16)]}
_BACK = {c: [[(cost, step, s) for s in range(4) for _, cost, step, to in _ARCS[c][s] if to == t] for t in range(4)] for c in _ARCS}


def distances(codes: bytes, end: list[int], last: bool) -> list[int]:
    """Least cost from each node, layer by layer, to the end, where leaving from node s costs ``end[s]`` more.

    ``last``: whether the conversation ends with this chunk, so that rows may be inserted behind it.
    """
    n = len(codes)
    dist = [_FAR] * (4 * n + 4)
    low = min(end)
    # the ends differ by a few units only; anything that is farther than the buckets reach is filed again on its turn
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    waiting = sorted((d - low, 4 * n + s) for s, d in enumerate(end) if d < _FAR)
    d, left, at = 0, len(waiting), 0
    while left:
        while at < len(waiting) and waiting[at][0] == d:
            buckets[d % _BUCKETS].append(waiting[at][1])
            at += 1
        here = buckets[d % _BUCKETS]
        while here:
            v = here.pop()
            left -= 1
            if dist[v] <= d:
                continue
            dist[v] = d
            layer, s = v >> 2, v & 3
            own = None if layer == n else codes[layer]
            if layer < n or last:
                for cost, step, u in _BACK[own][s]:
                    if not step and dist[4 * layer + u] > d + cost:
                        buckets[(d + cost) % _BUCKETS].append(4 * layer + u)
                        left += 1
            if layer:
                for cost, step, u in _BACK[codes[layer - 1]][s]:
                    if step and dist[v - s - 4 + u] > d + cost:
                        buckets[(d + cost) % _BUCKETS].append(v - s - 4 + u)
                        left += 1
        d += 1
    return [x + low if x < _FAR else _FAR for x in dist]


def walk(codes: bytes, dist: list[int], node: int, last: bool) -> tuple[str, list[tuple[str, int, int]], int]:
    """(audit, (letter, row or -1, node) of each edit, node at the end) of the least audit from ``node``."""
    n, layer, letters, steps = len(codes), 0, [], []
    while layer < n or last:
        d = dist[4 * layer + node]
        if layer == n and d == 0:
            break
        for letter, cost, step, to in _ARCS[codes[layer] if layer < n else None][node]:
            if dist[4 * (layer + step) + to] + cost == d:
                break
        else:
            raise AssertionError("no tight arc")
        letters.append(letter)
        steps.append((letter, layer if step else -1, to))
        layer, node = layer + step, to
    return "".join(letters), steps, node


GOAL = [0, _FAR, _FAR, 0]


# --- tables


def _grouped(table: DataFrame, keys: list[str], order: list[Column | str], run: Callable[[list], Iterator[dict]], schema: str, start: Callable[[], list] = list) -> DataFrame:
    """``run`` over the rows of each task in the order of keys and ``order``; ``start`` makes what it keeps across batches."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = start()
        for batch in batches:
            out = run(held, batch)
            if out:
                yield pd.DataFrame(out)

    return table.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(task, schema)


def _chunks(rows: DataFrame) -> DataFrame:
    """(c, chunk, codes, last) of conversations of more than one chunk."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"])
    return rows.groupBy("c", "chunk").agg(w.alias("codes"), F.first("last").alias("last"))


def _ends(rows: DataFrame) -> DataFrame:
    """(c, chunk, end, node, before) of conversations of more than one chunk: costs at a chunk's end, the node where the
    walk enters it, and the code before it."""
    chunks = written(_chunks(rows), "turn-chunks")

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                codes = bytes(r.codes.tolist())
                if r.last:
                    cost = distances(codes, GOAL, True)[:4] * 4  # whatever stands behind
                else:
                    cost = [x for t in range(4) for x in distances(codes, [0 if s == t else _FAR for s in range(4)], False)[:4]]
                out.append((r.c, r.chunk, r.last, cost, int(codes[-1])))
            yield pd.DataFrame(out, columns=["c", "chunk", "last", "cost", "final"])

    costs = written(chunks.mapInPandas(through, "c string, chunk long, last boolean, cost array<long>, final int"), "turn-costs")

    def back(held: list, b: pd.DataFrame) -> dict:
        out = []
        for r in b.itertuples():
            end = GOAL if r.last else held[0]
            cost = np.asarray(r.cost).reshape(4, 4)  # by node at the end, then node at the start
            held[:] = [cost[0].tolist() if r.last else np.minimum((cost + np.asarray(end)[:, None]).min(axis=0), _FAR).tolist()]
            out.append(end)
        return {"c": b["c"], "chunk": b["chunk"], "end": out}

    ends = _grouped(costs, ["c"], [F.desc("chunk")], back, "c string, chunk long, end array<long>")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                codes, end = bytes(r.codes.tolist()), [int(x) for x in r.end]
                dist = distances(codes, end, bool(r.last))
                out.append((r.c, r.chunk, [walk(codes, dist, s, bool(r.last))[2] if dist[s] < _FAR else -1 for s in range(4)]))
            yield pd.DataFrame(out, columns=["c", "chunk", "to"])

    ends = written(ends, "turn-ends")
    tos = chunks.join(ends, ["c", "chunk"]).select("c", "chunk", "codes", "last", "end").mapInPandas(across, "c string, chunk long, to array<int>")

    def forth(held: list, b: pd.DataFrame) -> dict:
        nodes, before = [], []
        for r in b.itertuples():
            node, code = (START, -1) if r.chunk == 0 else held
            nodes.append(node)
            before.append(code)
            held[:] = [int(r.to[node]), int(r.final)]
        return {"c": b["c"], "chunk": b["chunk"], "node": nodes, "before": before}

    nodes = _grouped(tos.join(costs.select("c", "chunk", "final"), ["c", "chunk"]), ["c"], ["chunk"], forth, "c string, chunk long, node int, before int")
    return written(nodes.join(ends, ["c", "chunk"]), "turn-nodes")


_EDITS = "c string, chunk long, j long, letter string, cost int, row binary, new_role string, illegal int, code int"


def _edits(rows: DataFrame) -> DataFrame:
    """One row for each edit: conversation, chunk, place j in it, letter, cost, the row's key, its new role, whether the
    row and the one before are an illegal pair, and the row's code (-1 for an inserted row)."""

    def solve(c: str, chunk: int, codes: bytes, keys: list[str], end: list[int], node: int, before: int, last: bool, out: list) -> None:
        dist = distances(codes, end, last)
        _, steps, _ = walk(codes, dist, node, last)
        for j, (letter, row, to) in enumerate(steps):
            if row < 0:
                out.append((c, chunk, j, letter, _COST[INSERT], None, _NAME[to], 0, -1))
                continue
            code = codes[row]
            prev = codes[row - 1] if row else before
            pair = 0 if prev < 0 or (prev & 3, code & 3) in ((1, 2), (2, 3), (3, 2)) else 1
            cost = _COST[letter] + (1 if letter != DELETE and code & TRUNCATED else 0)
            out.append((c, chunk, j, letter, cost, keys[row], _NAME[to] if letter == REROLE else None, pair, code))

    columns = [c.split(" ")[0] for c in _EDITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def close(out: list) -> None:
            if held:
                solve(held["c"], held["chunk"], bytes(held["codes"]), held["keys"], held["end"], held["node"], held["before"], held["last"], out)
                held.clear()

        for b in batches:
            out: list = []
            for c, chunk, code, key, end, node, before, last in zip(b["c"], b["chunk"], b["code"], b["k"], b["end"], b["node"], b["before"], b["last"], strict=True):
                if not held or (held["c"], held["chunk"]) != (c, chunk):
                    close(out)
                    whole = end is None
                    held.update(c=c, chunk=chunk, codes=bytearray(), keys=[], end=GOAL if whole else [int(x) for x in end], node=START if whole else int(node), before=-1 if whole else int(before), last=bool(last))
                held["codes"].append(code)
                held["keys"].append(key)
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = []
        close(out)
        if out:
            yield pd.DataFrame(out, columns=columns)

    many = rows.where("n > chunk_rows")
    # no action asks whether there is a long conversation: without one these tables are empty
    ends = _ends(many)
    held = rows.join(ends, ["c", "chunk"], "left").select("c", "chunk", "pos", "code", "k", "end", "node", "before", "last")
    return held.repartition("c", "chunk").sortWithinPartitions("c", "chunk", "pos").mapInPandas(run, _EDITS)


def _key(*parts: Column) -> Column:
    """A digest of strings that tells where one ends."""
    sized = [x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)]
    return F.unhex(F.md5(F.concat(*sized).cast("binary")))


def normal(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turn, role, text): a null role or text is one blank; ``c`` is the conversation's id as text, told from null."""
    s = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    c = F.when(F.col(conv_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(conv_col).cast("string")))
    return conversations.select(c.alias("c"), F.col(turn_col).cast("long").alias("turn"), s(role_col).alias("role"), s(text_col).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of :func:`normal` after damage by a checksum of conversation and turn; ``times`` is 2 for a repeated row."""
    conv = F.when(F.col("c") == "-", F.lit(" ")).otherwise(F.expr("substring(c, 2)"))
    kind = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.where(kind != 0).select("c", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"))


def repair(rows: DataFrame, *, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The edits of all conversations, and the rows they leave.

    ``rows``: (c, turn, role, text, times), no nulls but in ``turn``; a row counts ``times`` times. Edits are as of
    :func:`_edits`, written. What is left: (c, chunk, j, role, text) in the order of chunk and j.

    A conversation's rows stand by turn (null first), then role, then text; equal ones beside each other. Faults: blank,
    duplicate (an earlier row has its role and text), truncated (does not end in a sentence's end); the first counts.

    Texts are read from ``rows`` twice (once more where rows share a turn) and otherwise represented by digests, so rows
    should be cheap to read again. Equal rows fall together before any shuffle. Which row of equal role and text comes
    first is a grouped minimum; no step gathers a conversation but the folds over chunk tables.
    """
    small_batches(rows.sparkSession)
    t = F.coalesce(F.col("turn").cast("string"), F.lit("-"))
    ink = F.rtrim(F.col("text"), F.lit(BLANKS))
    keyed = rows.select("c", "turn", "role", "times", _key(F.col("c"), t, F.col("role"), F.col("text")).alias("k"), _key(F.col("role"), F.col("text")).alias("same"), ink.alias("ink"))
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    keyed = keyed.select("c", "turn", "role", "times", "k", "same", code.alias("who"), (F.col("ink") == "").alias("blank"), (~F.substring(F.col("ink"), -1, 1).rlike(END)).alias("cut"))
    merged = written(keyed.groupBy("k", "c", "turn", "role", "same", "who", "blank", "cut").agg(F.sum("times").alias("times")), "turn-rows")
    # rows that share a turn and a role: by text
    shared = merged.groupBy("c", "turn", "role").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("c", "turn", "role")
    mine = merged.join(shared, (merged["c"] == shared["c"]) & merged["turn"].eqNullSafe(shared["turn"]) & (merged["role"] == shared["role"]), "left_semi").select("k")
    tied = rows.select(_key(F.col("c"), t, F.col("role"), F.col("text")).alias("k"), "text").join(mine, "k").groupBy("k").agg(F.first("text").alias("tie"))
    leads = merged.groupBy("c", "same").agg(F.min_by("k", F.struct(F.col("turn").isNotNull(), "turn")).alias("k")).select("k", F.lit(True).alias("lead"))
    each = merged.join(leads, "k", "left").join(tied, "k", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    fault = F.when(F.col("blank"), GOES).when(F.col("lead").isNull() | (F.col("copy") > 1), GOES + TRUNCATED).when(F.col("cut"), TRUNCATED).otherwise(0)
    each = each.select("c", "turn", "role", F.coalesce("tie", F.lit("")).alias("tie"), "k", "copy", (F.col("who") + fault).alias("code"))
    placed = written(ranked(each, [F.asc("c"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("k"), F.asc("copy")]).select("c", "k", "code", "rank"), "turn-ranks")
    sizes = placed.groupBy("c").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("n"))
    pos = F.col("rank") - F.col("low")
    cut = placed.join(sizes, "c").select("c", "k", "code", "n", pos.alias("pos"), F.floor(pos / chunk).alias("chunk"), (F.floor(pos / chunk) == F.floor((F.col("n") - 1) / chunk)).alias("last"), F.lit(chunk).alias("chunk_rows"))
    edits = written(_edits(cut), "turn-edits")
    stay = edits.where(F.col("letter").isin(KEEP, REROLE)).select("c", "chunk", "j", "row", "new_role")
    texts = rows.select(_key(F.col("c"), t, F.col("role"), F.col("text")).alias("row"), "role", "text").groupBy("row").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = texts.join(stay, "row").select("c", "chunk", "j", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.where(F.col("letter") == INSERT).select("c", "chunk", "j", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return edits, kept.unionByName(added)


def _digests(left: DataFrame) -> DataFrame:
    """(c, repaired_sha256): SHA-256 over ``role:text`` of a conversation's rows, newline-joined, one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for c, role, text in zip(b.column("c").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if c != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pydict({"c": pa.array([c for c, _ in done], pa.string()), "repaired_sha256": pa.array([h for _, h in done], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"c": pa.array([now], pa.string()), "repaired_sha256": pa.array([state.hexdigest()], pa.string())})

    return left.repartition("c").sortWithinPartitions("c", "chunk", "j").select("c", "role", "text").mapInArrow(run, "c string, repaired_sha256 string")


def repair_report(conversations: DataFrame, *, chunk: int = CHUNK, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row a conversation: its faults after damage, the cost and the audit of the cheapest repair, and a digest of it.

    Defined cases: a null role or text is one blank, and a null id a conversation; rows without a turn come first; a
    role that begins with none of s, u, a can be reroled or deleted only; a conversation without rows after damage has
    zeros, an empty audit and the digest of nothing; an empty table gives an empty table; other columns are left out.
    The digest is over a whole conversation in order, so one task streams it, a row at a time.
    """
    base = normal(conversations, conv_col=conv_col, **columns)
    rows = damage(base)
    edits, left = repair(rows, chunk=chunk)
    is_row, goes = F.col("code") >= 0, F.col("code") >= GOES
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias
    parts = edits.groupBy("c", "chunk").agg(
        count(is_row & goes & (F.col("code") < GOES + TRUNCATED))("blank"), count(goes & (F.col("code") >= GOES + TRUNCATED))("duplicate"),
        count(is_row & ~goes & (F.col("code") >= TRUNCATED))("truncated"), count(F.col("illegal"))("illegal"), count(F.col("cost"))("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "letter"))), lambda s: s["letter"]), "").alias("audit"),
    )
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    sums = parts.groupBy("c").agg(*[F.sum(x).alias(x) for x in names], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    turns = rows.groupBy("c", "turn").agg(F.lit(1)).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = base.select("c").distinct().join(turns, "c", "left").join(sums, "c", "left").join(_digests(left), "c", "left")
    kind = conversations.schema[conv_col].dataType
    conv = F.when(F.col("c") != "-", F.expr("substring(c, 2)")).cast(kind).alias("conv_id")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(conv, zero("gaps"), *[zero(x) for x in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
