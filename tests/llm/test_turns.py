"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from heronry.llm import turns as T

SCHEMA = "conv_id long, turn long, role string, text string"


def best(initials, faults):
    """The cheapest edits and of these the least audit, by plain relaxation from the end."""
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    far = (1 << 40, "~")
    behind = None
    for i in range(len(initials), -1, -1):
        now = {s: (0, "") if i == len(initials) and s in ("", "a") else far for s in nexts}
        while True:
            old = dict(now)
            for s in nexts:
                options = [now[s], (now[nexts[s]][0] + 2, "I" + now[nexts[s]][1])]
                if i < len(initials):
                    options.append((behind[s][0] + 3, "D" + behind[s][1]))
                    if faults[i] not in ("blank", "duplicate"):
                        more = 1 if faults[i] == "truncated" else 0
                        r = initials[i]
                        if r == nexts[s] or r == "s" and s == "":
                            options.append((behind[r][0] + more, "K" + behind[r][1]))
                        options.append((behind[nexts[s]][0] + 2 + more, "R" + behind[nexts[s]][1]))
                now[s] = min(options)
            if now == old:
                break
        behind = now
    return behind[""]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        c = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        c += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, c in convs.items():
        c.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in c:
            ink = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in c]
        cost, audit = best(initials, faults)
        left, i = [], 0
        for letter in audit:
            role = "assistant" if left and left[-1].startswith("u") else "user"
            if letter == "I":
                left.append(f"{role}:")
                continue
            if letter != "D":
                left.append(f"{c[i][1] if letter == 'K' else role}:{c[i][2]}")
            i += 1
        turns = [r[0] for r in c if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "and then", " \n\t", "", None, "Why?\n", "é ü.", "a\x85", "x\ny.\x0b "]) if rng.random() < 0.6 else f"line {rng.random()}."
            rows.append((conv if conv else None, turn if rng.random() < 0.95 else None, role, text))
    rows += [(3, 1, "user", "tie b."), (3, 1, "user", "tie a."), (3, 1, "assistant", "tie."), (7, None, "user", "x."), (7, None, "user", "x.")]
    rows += [(conv, turn, r, t) for conv, turn, r, t in rows if conv == 9]
    return rows



def got(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_distances_and_walk_by_brute_force():
    rng = random.Random(0)
    names = {0: "", T.TRUNCATED: "truncated", T.GOES: "blank", T.GOES + T.TRUNCATED: "duplicate"}
    for _ in range(400):
        rows = [(rng.choice([0, 1, 2, 3, 2, 3]), rng.choice([0, 0, 0, 4, 8, 12])) for _ in range(rng.randrange(8))]
        codes = bytes(a + b for a, b in rows)
        dist = T.distances(codes, T.GOAL, True)
        audit, _, _ = T.walk(codes, dist, T.START, True)
        assert (dist[0], audit) == best(["xsua"[a] for a, _ in rows], [names[b] for _, b in rows])


def test_chunks_give_the_distances_of_the_whole():
    rng = random.Random(1)
    codes = bytes(rng.choice([1, 2, 3]) + rng.choice([0, 0, 4, 8]) for _ in range(50))
    whole = T.distances(codes, T.GOAL, True)
    tail = T.distances(codes[20:], T.GOAL, True)
    assert tail == whole[80:]
    assert T.distances(codes[:20], tail[:4], False)[:80] == whole[:80]


@pytest.mark.parametrize("chunk", [T.CHUNK, 3])
def test_report(spark, chunk):
    rows = talk()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(T.repair_report(df, chunk=chunk)) == brute(rows)


def test_a_long_conversation(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", "c", f"{t}.", f"{t}"])) for t in range(3000)]
    rows += [(2, 5, "user", "the same.")] * 900
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(T.repair_report(df, chunk=64)) == brute(rows)


def test_odd_tables(spark):
    assert T.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None)] * 3
    assert got(T.repair_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    gone = [(c, t, "user", "x.") for c in range(300) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    clash = spark.createDataFrame(gone, SCHEMA)
    for name in ("c", "k", "row", "rank", "code", "chunk", "pos", "n", "copy", "tie", "lead", "times", "letter", "j"):
        clash = clash.withColumn(name, F.lit("x"))
    assert gone and got(T.repair_report(clash)) == brute(gone) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone]


def test_what_is_left_is_rows(spark):
    rows = spark.createDataFrame([("=1", 0, "user", "Hello.", 1), ("=1", 1, "user", "Again", 1)], "c string, turn long, role string, text string, times long")
    edits, left = T.repair(rows)
    assert [r.letter for r in edits.orderBy("j").collect()] == ["K", "R"]
    assert [(r.role, r.text) for r in left.orderBy("chunk", "j").collect()] == [("user", "Hello."), ("assistant", "Again")]
