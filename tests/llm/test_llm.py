"""Operators of heronry.llm against brute force, on small tables with odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heronry.llm import buffers as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(n=120, seed=3):
    """Texts with copies, near copies, shared passages, odd blanks, null and empty ones, and one long one."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(vocab) for _ in range(k))

    passage = prose(70)
    texts = [None, "", " \t\n", "one", "two words", "A\x1cB c\x85d e", "x y\nx y\nX Y \n\n z"]
    texts += [prose(rng.randint(1, 150)) for _ in range(n - 40)]
    texts += [prose(30) + "\n" + passage + "\n" + prose(rng.randint(0, 40)) for _ in range(10)]
    base = prose(120).split(" ")
    for _ in range(12):
        edited = list(base)
        edited[rng.randrange(len(edited))] = rng.choice(vocab)
        texts.append(" ".join(edited))
    texts += [texts[10]] * 4 + [" ".join(["again"] * 60)] + [prose(3000)]
    rng.shuffle(texts)
    return [(3 * i + 1, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def odd_tables(spark):
    """Empty; all nulls; repeated rows and ids; columns whose names are used inside."""
    yield spark.createDataFrame([], SCHEMA)
    yield spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)
    yield spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "c d", "en", "s", 3), (None, "a b", None, None, 3)], SCHEMA)
    clash = spark.createDataFrame([(1, "a b c", "en", "s", 3), (2, "d e f", "en", "s", 3)], SCHEMA)
    for name in ("row", "k1", "k2", "key", "part", "kind", "label", "host", "fp", "gram", "tag", "pos", "n", "a", "b"):
        clash = clash.withColumn(name, F.lit("x"))
    yield clash


# --- kernels


def test_words_and_hashes_follow_bytes(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, doc = B.words(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in t.split()]
    assert doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    assert [w.encode() for _, t, *_ in rows for w in words(t)] == [w for t in texts for w in t.split()]
    hashes = B.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len({data[a:b].tobytes() for a, b in zip(starts, ends)})
    windows = B.Windows(hashes)
    at = B.whole_windows(doc, 3)
    got = windows.get(at, 3)
    seen = {}
    for p, h in zip(at.tolist(), got.tolist()):
        assert seen.setdefault(h, hashes[p : p + 3].tolist()) == hashes[p : p + 3].tolist()


# --- op7


def lines_brute(rows, least=10):
    key = lambda line: re.sub(f"^{BLANK}+|{BLANK}+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark, docs, rows):
    from heronry.llm.lines import drop_frequent_lines

    out = drop_frequent_lines(docs).select("doc_id", "__n_lines", "__n_dropped", F.sha2("text", 256))
    assert sorted(map(tuple, out.collect())) == lines_brute(rows)
    for t in odd_tables(spark):
        got = drop_frequent_lines(t, min_docs=2)
        assert got.count() == t.count() and got.columns[2:] == t.columns


# --- op6


def test_mixing_counts_follow_the_inverse_distribution(spark, docs, rows):
    from math import exp

    from heronry.llm.mixing import mix_sources, poisson_count, source_rates

    rates = {r["__source"]: r["__rate"] for r in source_rates(docs).collect()}
    mass = {}
    for _, t, _, s, _ in rows:
        mass[s] = mass.get(s, 0) + max(len(t or ""), 1)
    root = sum(m**0.5 for m in mass.values())
    for s, m in mass.items():
        assert rates[s] == pytest.approx(m**0.5 / root * sum(mass.values()) / m)

    def count(i, rate):
        u = (int(hashlib.md5(f"42:{i}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, exp(-rate)
        c = p
        while u > c:
            k += 1
            p = p * rate / k
            c += p
        return k

    got = {}
    out = mix_sources(docs).collect()
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, _, _, s, _ in rows if (n := count(i, rates[s]))}
    assert [r["__order"] for r in out] == sorted(r["__order"] for r in out)
    big = spark.range(2000).select(poisson_count(F.lit(100.0), 1, F.col("id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(big[0] - 100) < 1 and abs(big[1] - 100) < 12
    for t in odd_tables(spark):
        assert mix_sources(t).columns[: len(t.columns)] == t.columns
    weighted = {r["__source"]: r["__rate"] for r in source_rates(docs, weights={"s0": 1.0}).collect()}
    assert weighted["s1"] == 0 and weighted["s0"] > 1


# --- op4


def quality_brute(rows, min_docs=10):
    key = lambda line: re.sub(f"^{BLANK}+|{BLANK}+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if words(line):
                held.setdefault((s or "", key(line)), set()).add(i)
    out = []
    for i, t, _, s, _ in rows:
        ws, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        hit = {k + j for k, g in enumerate(grams) if g in twice for j in range(8)}
        common = sum(len(words(x)) for x in lines if len(held[s or "", key(x)]) >= min_docs)
        left = len(ws) - common
        base = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
        kept = not base and not (common and (left < 20 or left < 0.3 * len(ws)))
        out.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), base, kept))
    return sorted(out)


def test_quality_rules(spark, docs, rows):
    from heronry.llm.quality import keep_good, quality_table

    for least in (2, 10):
        out = quality_table(docs, min_docs=least).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        assert sorted(map(tuple, out.collect())) == quality_brute(rows, least)
    long = [(9001, " ".join(f"w{k % 900}" for k in range(2000)), "en", "s", 1), (9002, " ".join(f"v{k}" for k in range(60_000)) + " a b c d e f g h" * 2, "en", "s", 1)]
    out = quality_table(spark.createDataFrame(long, SCHEMA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, out.collect())) == quality_brute(long)
    # a line in ten documents of a host, also where the host has many: those that hold little else are depleted
    prose = lambda k: " ".join(f"u{k}x{j}" for j in range(30))
    banner = " ".join(f"banner{j}" for j in range(40))
    site = [(k, prose(k) if k >= 24 else banner + "\n" + prose(k) if k >= 12 else banner + "\nlast words", "en", "big", 1) for k in range(400)]
    site += [(1000 + k, banner + "\nlast words", "en", "small", 1) for k in range(9)] + [(2000, banner + "\nlast words", "en", "small", 1)]
    verdict = {r.doc_id: r for r in quality_table(spark.createDataFrame(site[:-1], SCHEMA)).collect()}
    assert all(verdict[k].kept == (k >= 12) and verdict[k].n_common_words == (42 if k < 12 else 40 if k < 24 else 0) for k in range(400))
    assert all(verdict[1000 + k].kept for k in range(9))
    assert not any(r.kept for r in quality_table(spark.createDataFrame(site, SCHEMA)).where("host = 'small'").collect())
    assert {r.doc_id: r.text for r in keep_good(spark.createDataFrame(site, SCHEMA)).collect() if r.doc_id < 40} == {k: prose(k) for k in range(12, 40)}
    kept = {r[0] for r in quality_brute(rows) if r[-1]}
    good = keep_good(docs)
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == docs.columns
    for t in odd_tables(spark):
        assert quality_table(t).count() == t.count()
        assert keep_good(t).columns == t.columns


# --- op5


def fingerprint_brute(text):
    ws = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] if len(ws) >= 4 else ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_brute(rows, radius=4):
    fps = {i: fingerprint_brute(t) for i, t, *_ in rows}
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_simhash_components(spark, docs, rows):
    from heronry.llm.near_simhash import keep_one_per_group, simhash_components

    out = simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    want = components_brute(rows)
    assert {r[0]: (r[1], r[2]) for r in out} == want
    kept = keep_one_per_group(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})
    for t in odd_tables(spark):
        assert simhash_components(t).count() == t.count()
        assert keep_one_per_group(t).columns == t.columns


def fingerprint_set(n=60):
    """Random fingerprints, and many about one point."""
    rng = np.random.default_rng(5)
    one = np.uint64(1)
    near = np.uint64(0xABCD12345678EF00) ^ (one << rng.integers(0, 64, 4 * n).astype(np.uint64)) ^ (one << rng.integers(0, 40, 4 * n).astype(np.uint64)) ^ (rng.integers(0, 3, 4 * n).astype(np.uint64) << np.uint64(20))
    return np.unique(np.concatenate((near, rng.integers(0, 1 << 63, n).astype(np.uint64), np.array([0, 1, 3, 2**64 - 1], np.uint64))))


def test_links_connect_as_all_pairs_do_also_in_hot_buckets(spark):
    from heronry.llm.components import local_roots
    from heronry.llm.near_simhash import hamming_links

    fps = fingerprint_set()
    i, j = np.triu_indices(len(fps), 1)
    dist = np.bitwise_count(fps[i] ^ fps[j])
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    for radius, block in ((0, 1000), (1, 7), (2, 1000), (4, 1000), (4, 7)):
        want = local_roots(i[dist <= radius], j[dist <= radius], len(fps))
        links = hamming_links(table, radius=radius, block=block).collect()
        assert all(bin(x.u % 2**64 ^ x.v % 2**64).count("1") > 0 for x in links)
        got = local_roots(np.array([at[x.u] for x in links], int), np.array([at[x.v] for x in links], int), len(fps))
        assert (got == want).all(), (radius, block)


def test_the_ring_lets_all_near_pairs_meet_and_prunes():
    """Each near pair has a chain; of random pairs that meet in one segment few keep to the budgets of longer chains."""
    from heronry.llm.near_simhash import chain_masks, within_chain

    rng = np.random.default_rng(9)
    for radius in (1, 2, 4, 7):
        masks = chain_masks(radius)
        diff = np.zeros(3000, np.uint64)
        for _ in range(radius):
            diff |= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
        starts = [set(within_chain(diff, np.full(3000, s), masks, range(1, radius + 2)).tolist()) for s in range(radius + 1)]
        assert set.union(*starts) == set(range(3000))
    masks = chain_masks(4)
    diff = rng.integers(0, 1 << 63, 400_000).astype(np.uint64) & ~masks[0, 0]  # the first segment is equal
    start = np.zeros(len(diff), int)
    left = [len(within_chain(diff, start, masks, range(1, n + 1))) for n in (1, 2, 3)]
    assert left[0] == len(diff) and left[1] < 0.01 * left[0] and left[2] < 0.1 * left[1]


def test_component_roots(spark):
    from heronry.llm.components import component_roots

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (200, 200), (None, 3)]
    out = {r.node: r.root for r in component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert component_roots(spark.createDataFrame([], "u long, v long")).count() == 0


# --- op1


def windows_brute(rows, depth=20):
    split = {i: words(t) for i, t, *_ in rows}
    seen, out = set(), []
    for i in sorted(split):
        ws, gone = split[i], set()
        for p in range(len(ws) - depth + 1):
            g = tuple(ws[p : p + depth])
            if g in seen:
                gone |= set(range(p, p + depth))
            seen.add(g)
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_suffix_trees(spark, docs, rows):
    from heronry.llm.suffix_trees import drop_repeats

    assert sorted(map(tuple, drop_repeats(docs).collect())) == windows_brute(rows)
    for small in ({"pack": 3000}, {"pack": 3000, "group": 40}, {"pack": 1}):  # many packs; prefixes made longer, and some dealt out in parts
        assert sorted(map(tuple, drop_repeats(docs, **small).collect())) == windows_brute(rows)
    assert sorted(map(tuple, drop_repeats(docs, depth=25, pack=3000).collect())) == windows_brute(rows, 25)
    for t in odd_tables(spark):
        assert drop_repeats(t).count() == t.count()
    long = " ".join(f"w{k}" for k in range(30))
    twice = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long + " more")], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in drop_repeats(twice).collect()) == [(1, 0), (1, 0), (2, 30), (9, 30)]


def test_subtrees_have_nodes_of_all_depths():
    """Shared words of neighbours in a subtree, and its outer nodes, against comparing words."""
    from heronry.llm.suffix_trees import REACH, cut_groups, outer_nodes, subtree

    rng = np.random.default_rng(2)
    depth = 20
    words_ = rng.integers(1, 4, (400, depth + REACH)).astype(np.uint16)
    words_[:, :17] = words_[0, :17]  # neighbours share 17 words or more
    words_[200:, 3:] = words_[200:, 3:][rng.integers(0, 40, 200)]
    words_[rng.random(400) < 0.1, depth + 1 :] = 0  # the document ends
    words_[398:] = np.arange(50, 50 + depth + REACH)
    words_[399, -1] = 9
    check = np.array([zlib.crc32(w[:depth].tobytes()) for w in words_])
    keys = np.concatenate((words_[:, :depth], (check >> 16)[:, None], (check & 0xFFFF)[:, None], words_[:, depth:]), axis=1).astype(">u2")
    order, shared = subtree(keys, depth)
    assert shared[0] == -1

    def common(a, b):
        n = 0
        while n < len(a) and a[n] == b[n] and a[n] > 0:
            n += 1
        return n

    for k in range(1, 400):
        assert shared[k] == common(words_[order[k - 1]], words_[order[k]])
    assert set(shared[1:].tolist()) >= {17, 18, 19, 20, 21, 22}
    first, last, deep = outer_nodes(shared, depth)
    groups = {}
    for w in words_:
        groups.setdefault(w[:depth].tobytes(), []).append(w)
    want = sorted((len(g), min(common(x, y) for x in g for y in g if x is not y)) for g in groups.values() if len(g) > 1)
    assert sorted(zip((last - first + 1).tolist(), deep.tolist())) == want and max(deep) > depth
    bounds, parts = cut_groups([(3, 10, 5), (0, 10, 4), (7, 16, 900), (1, 10, 7)], 10)
    assert bounds.tolist() == [0, 7 << 48, 1 << 54, 3 << 54] and parts.tolist() == [1, 90, 1, 1]


# --- op3


def test_sparse_suffixes(spark, docs, rows):
    from heronry.llm import anchors as A
    from heronry.llm.sparse_suffixes import repeated_passages

    least = 50
    depth = least - A.SPAN + 1
    spans = {}
    for r in repeated_passages(docs, least=least).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.end_word - r.start_word == r.n_words >= depth and r.other_doc_id is not None
    split = {i: words(t) for i, t, *_ in rows}
    where = {}
    for n in (depth, least):
        for i, ws in split.items():
            for p in range(len(ws) - n + 1):
                where.setdefault(tuple(ws[p : p + n]), set()).add((i, p))
    for i, ws in split.items():
        mine = spans.get(i, [])
        for p in range(len(ws) - least + 1):  # complete
            if len(where[tuple(ws[p : p + least])]) > 1:
                assert any(a <= p and p + least <= b for a, b in mine), (i, p)
        for a, b in mine:  # sound: each word is in a repeated run of the least depth
            assert 0 <= a < b <= len(ws)
            hit = set()
            for p in range(a, b - depth + 1):
                if len(where[tuple(ws[p : p + depth])]) > 1:
                    hit |= set(range(p, p + depth))
            assert hit == set(range(a, b)), (i, a, b)
        for (_, b), (a, _) in zip(sorted(mine), sorted(mine)[1:]):
            assert b < a
    for t in odd_tables(spark):
        assert repeated_passages(t).count() == 0
    long = " ".join(f"w{k}" for k in range(80))
    same = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert repeated_passages(same).count() == 0
    assert repeated_passages(same.union(spark.createDataFrame([(2, "z " + long)], "doc_id long, text string"))).select("doc_id", "start_word", "end_word").orderBy("doc_id").collect() == [(1, 0, 80), (2, 1, 81)]


def test_passages_whose_parts_stand_elsewhere(spark):
    """A and B share a passage, its tail or head also stands in C, at other places of the chain than in B."""
    from heronry.llm.sparse_suffixes import repeated_passages

    rng = random.Random(8)
    words_ = lambda k: [f"x{rng.randrange(10**6)}" for _ in range(k)]
    texts, want = [], []
    for k in range(200):
        passage, j = words_(50), rng.randrange(1, 14)
        part = passage[j:] if k % 2 else passage[:-j]
        texts += [words_(30) + passage + words_(30), words_(30) + passage + words_(30), words_(30) + part + words_(30)]
        want += [(3 * k, 30, 80), (3 * k + 1, 30, 80)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {}
    for r in repeated_passages(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert [w for w in want if not any(a <= w[1] and w[2] <= b for a, b in spans.get(w[0], []))] == []


# --- op8


def test_fingerprints(spark, docs, rows):
    from heronry.llm.fingerprints import count_near, edited, fingerprint_with_edits, likeness, simhash_texts

    ordered = sorted(rows, key=lambda r: -r[0])
    out = {r.doc_id: r for r in fingerprint_with_edits(docs).collect()}
    assert len(out) == len(rows)
    for k, (i, t, *_) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = edited(t, nxt)
        assert e == t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = (simhash_texts([x.encode()]) for x in (t, e, nxt))
        r = out[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex())
        assert (r.near_edited, r.near_next) == (likeness(a, b)[0], likeness(a, c)[0])
    prints = spark.createDataFrame([(i, r.fingerprint) for i, r in out.items()], "doc_id long, fingerprint string")
    for radius in (3, 12):
        got = {r.doc_id: r.n_near for r in count_near(prints, radius=radius, every=2).collect()}
        want = {i: sum(j != i and bin(int(r.fingerprint, 16) ^ int(s.fingerprint, 16)).count("1") <= radius for j, s in out.items()) for i, r in out.items() if i % 2 == 0}
        assert got == want
    for t in odd_tables(spark):
        assert fingerprint_with_edits(t).count() == t.count()


def test_search_finds_near_copies(spark, monkeypatch):
    """Planted copies with three words replaced: the query's radius finds nine in ten, radius 3 next to none."""
    from heronry.llm import fingerprints, queries

    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(200)]
        copy = list(base)
        for p in rng.sample(range(200), 3):
            copy[p] = "replaced"
        texts += [(50 * k, " ".join(base)), (50 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(queries, "_read", lambda *_: docs)
    near = {r.doc_id: r.n_near for r in queries.op8_simhash_fingerprints(spark, "").where("n_near IS NOT NULL").select("doc_id", "n_near").collect()}
    assert len(near) == 60 and max(near.values()) == 1 and sum(near.values()) >= 54
    prints = fingerprints.fingerprint_with_edits(docs).select("doc_id", "fingerprint")
    assert sum(r.n_near for r in fingerprints.count_near(prints, radius=3).collect()) < 10
    bits = {r.doc_id: int(r.fingerprint, 16) for r in prints.collect()}
    for radius in (11, 17, 45):  # exact: as all pairs
        want = {i: sum((a ^ b).bit_count() <= radius for j, b in bits.items() if j != i) for i, a in bits.items() if i % 50 == 0}
        assert {r.doc_id: r.n_near for r in fingerprints.count_near(prints, radius=radius).collect()} == want
    monkeypatch.setattr(fingerprints, "DENSE", 2)  # every bucket of more entries in parts: same counts
    assert {r.doc_id: r.n_near for r in fingerprints.count_near(prints, radius=17).collect()} == near


# --- op9


def test_packing(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from heronry.llm.packing import pack

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [(1001, "It's 12,5 DON'T. Σας ΟΔΟΣ. <|endoftext|> <|EndOfText|>. é. ẛ̣, İ.", "en", "s", 1)]
    table = docs.union(spark.createDataFrame(odd, SCHEMA))
    out = pack(table, size=64).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    got = {}
    for r in out:
        got.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, r.ids_crc32)
    for i, t, *_ in rows + odd:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = {k: (64 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids[p : p + 64] for p in range(0, len(ids), 64))}
        assert got[i] == want, i
    lengths = [r.length for r in out]
    assert len(by_seq) <= best_fit(lengths, 64) * 1.02
    for t in odd_tables(spark):
        assert pack(t).count() == t.count()


def best_fit(lengths, size):
    """How many sequences best-fit decreasing opens, one piece after another."""
    import bisect

    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        room = gaps.pop(k) if k < len(gaps) else size
        bisect.insort(gaps, room - n)
    return len(gaps)


@pytest.mark.parametrize(("size", "some"), [(400, None), (90, ("halves", "third alike"))])
def test_supersteps_match_as_best_fit_does(spark, monkeypatch, size, some):
    """Every piece gets one place, none overlap, and no more sequences are opened than one by one (1 % more at most).

    Ranges have a fixed size, however many partitions a shuffle has, and there are far more rows than that."""
    from heronry.llm import packing

    rng = random.Random(4)
    mixes = {
        "halves": [rng.randint(900, 1200) for _ in range(300)],
        "third alike": [700] * 400 + [rng.randint(1, 2048) for _ in range(800)],
        "tiny": [1] * 5000 + [rng.randint(1, 30) for _ in range(500)],
        "long tail": [min(2048, int(rng.paretovariate(0.8) * 40)) for _ in range(2000)],
        "whole": [2048] * 20,
        "one": [5],
    }
    monkeypatch.setattr(packing, "RANGE", size)  # several ranges, so that matches cross them
    for name, lengths in mixes.items():
        if some and name not in some:
            continue
        pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, size long")
        out = packing.place(pieces, 2048).collect()
        assert sorted((r.key, r.size) for r in out) == list(enumerate(lengths)), name
        assert len({(r.sequence, r.step, r.nth) for r in out}) == len(out), name
        held = {}
        for r in out:
            held[r.sequence] = held.get(r.sequence, 0) + r.size
        assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held))), name
        assert len(held) <= best_fit(lengths, 2048) * 1.01, (name, len(held), best_fit(lengths, 2048))


def test_a_sweep_gives_each_piece_the_smallest_gap_left():
    from heronry.llm.packing import sweep_range, sweep_ranges

    # gaps of 9 (two pieces), 5 and 3; pieces of 6, 5, 4, 4, 2, 1
    rows = [(9, None, 0, 2), (6, 10, None, 1), (5, None, 1, 1), (5, 11, None, 1), (4, 12, None, 1), (4, 13, None, 1), (3, None, 2, 1), (2, 14, None, 1), (1, 15, None, 1)]
    matches, left, gaps = sweep_range(*map(list, zip(*rows)))
    assert matches == [(10, 6, 0, 0), (11, 5, 1, 0), (12, 4, 0, 1), (14, 2, 2, 0)] and left == [(13, 4), (15, 1)] and gaps == []
    assert sweep_ranges({0: (0, 3), 1: (2, 4), 2: (6, 0), 3: (1, 1)}) == [(1, 0, 0, 0, 2), (2, 0, 1, 0, 4), (2, 4, 0, 2, 1)]


# --- op10


def test_classifier_learns_and_never_reads_held_out_labels(spark):
    from heronry.llm.classifier import score_quality

    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "house", "green", "over", "river", "stone"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "WIN!!"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(out) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [r for i, r in out.items() if r.held_out and i < 400]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.98 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in score_quality(docs, flipped).collect()}
    assert again == {i: r.score for i, r in out.items()}
    assert all(r.score == 0.5 for r in score_quality(docs, labels.limit(0)).collect())
    for t in odd_tables(spark):
        assert score_quality(t, labels).count() == t.count()


# --- op2


def secrets_brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets(spark, docs, rows):
    from heronry.llm.secret_crf import find_secrets

    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    prose = lambda n: " ".join(rng.choice(["der", "éte", "house", "on", "12,5", "a@b.org", "10.0.0.1", "2024-01-02"]) for _ in range(n))
    planted = []
    for i in range(120):
        what = [f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(rng.choice("ABCDEFGHJK0123") for _ in range(16)), "API_KEY: short", f"ſecret={hexes(9)}", f"token=abc token='{hexes(7)}"][i % 6]
        planted.append((1000 + i, f"{prose(20)} {what} {prose(20)}", "en", "s", 1))
    table = docs.union(spark.createDataFrame(planted, SCHEMA))
    out = {r.doc_id: r for r in find_secrets(table).collect()}
    assert len(out) == len(rows) + len(planted)
    for i, t, *_ in rows + planted:
        base, r = secrets_brute(t), out[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, t, r)
        assert [x for x in r.spans.split(",") if x and not x.startswith("crf")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
    assert all(not out[i].spans for i, *_ in rows)
    for t in odd_tables(spark):
        assert find_secrets(t).count() == t.count()


def test_the_field_finds_secrets_that_no_pattern_matches(spark):
    """Secrets of forms and behind words of their own, in texts that weren't fitted: nine in ten found, nine in ten right."""
    from heronry.llm.secret_crf import find_secrets, fit

    rng = random.Random(77)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 9))) for _ in range(800)]

    def prose(k):
        extra = [f"{rng.randint(1, 10**6)}", f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{rng.choice(vocab)}@{rng.choice(vocab)}.org", f"v{rng.randint(1, 9)}.{rng.randint(0, 30)}", f"https://{rng.choice(vocab)}.net/{rng.choice(vocab)}"]
        return " ".join(rng.choice(extra) if rng.random() < 0.03 else rng.choice(vocab) for _ in range(k))

    alnum = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    code = lambda n: "".join(rng.choice(alnum) for _ in range(n))
    train = spark.createDataFrame([(i, prose(rng.randint(40, 200))) for i in range(1500)], "doc_id long, text string").repartition(4)
    field = fit(train, windows=8000)
    texts, want = [], {}
    for i in range(400):
        text = prose(rng.randint(30, 120))
        if i % 2:
            before, value = [("Signing key: ", code(32)), ("bearer ", code(40)), ("login=", code(6) + "7" + code(5)), ("sk_live_", code(24)), ("pwd is ", code(14)), ("license key ", "-".join(code(5).upper() for _ in range(4)))][i % 6]
            head = text + " " + before
            if before == "sk_live_":
                head, value = text + " ", before + value
            text, want[i] = head + value + "\n" + prose(40), (len(head), len(head) + len(value))
        texts.append((i, text))
        assert not secrets_brute(text)
    out = find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), field=field).collect()
    found = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in out}
    assert sum(r.n_crf for r in out) > 0 and all(r.n_crf == len(found[r.doc_id]) for r in out)
    hit = sum(any(a < want[i][1] and b > want[i][0] for a, b in found[i]) for i in want)
    exact = sum(want[i] in found[i] for i in want)
    right = sum(any(a < want[i][1] and b > want[i][0] for i in [i] if i in want) for i, spans in found.items() for a, b in spans)
    all_ = sum(map(len, found.values()))
    print("recall", hit / len(want), "exact", exact / len(want), "precision", right / all_)
    assert hit >= 0.9 * len(want) and exact >= 0.8 * len(want) and right >= 0.9 * all_


def test_the_gradient_is_that_of_the_likelihood():
    from heronry.llm.secret_crf import HASHED, NEAR, Field, likelihood

    rng = np.random.default_rng(3)
    n, length, width = 5, 6, 7
    x, y = rng.random((n, length, width)) < 0.4, rng.integers(0, 3, (n, length))
    near = rng.choice([0, 5, HASHED], (n, length, len(NEAR))).astype(np.int16)
    field = Field(rng.normal(size=(width, 3)), rng.normal(size=(len(NEAR), HASHED + 1, 3)), rng.normal(size=(3, 3)))
    loss, grads = likelihood(field, x, near, y, 0.01)
    # the loss itself: sums over all paths
    from itertools import product

    def path(s, tags):
        return sum(s[t, k] for t, k in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:]))

    total = 0.0
    for i in range(n):
        s = field.scores(x[i].T, near[i].T)
        total += np.log(sum(np.exp(path(s, tags)) for tags in product(range(3), repeat=length))) - path(s, y[i].tolist())
    assert loss == pytest.approx(total / n + 0.005 * sum((w**2).sum() for w in (field.emit, field.words, field.move)))
    for w, g, spots in ((field.emit, grads[0], [(0, 0), (3, 2)]), (field.words, grads[1], [(0, 5, 1), (3, HASHED, 0), (1, 9, 2)]), (field.move, grads[2], [(0, 1), (2, 2)])):
        for at in spots:
            old, step = w[at], 1e-5
            w[at] = old + step
            up = likelihood(field, x, near, y, 0.01)[0]
            w[at] = old - step
            down = likelihood(field, x, near, y, 0.01)[0]
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_viterbi_cut_at_sure_tokens_is_exact():
    from heronry.llm.secret_crf import Field

    rng = np.random.default_rng(0)
    field = Field(np.zeros((1, 3)), np.zeros((4, 1, 3)), rng.normal(0, 1, (3, 3)))
    scores = rng.normal(0, 2, (400, 3))
    scores[rng.random(400) < 0.6, 0] += 15
    text = np.sort(rng.integers(0, 7, 400))
    want = np.concatenate([field.viterbi(scores[text == k][None])[0] for k in range(7)])
    assert (field.decode(scores, text) == want).all()


# --- very long texts and hot keys, by values


def test_a_text_of_several_steps_and_a_hot_text(spark):
    """A text far beyond one array step, and one that a third of all rows hold: every operator against brute force."""
    from heronry.llm.fingerprints import fingerprint_with_edits, simhash_texts
    from heronry.llm.lines import drop_frequent_lines
    from heronry.llm.near_simhash import simhash_components
    from heronry.llm.packing import pack
    from heronry.llm.quality import quality_table
    from heronry.llm.suffix_trees import drop_repeats

    rng = random.Random(12)
    vocab = [f"{rng.choice('bcdfgh')}{k:x}" for k in range(5000)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    hot = prose(60) + "\nsame line\n" + prose(30)
    shared = prose(200)
    long = prose(40_000) + "\n" + shared + "\nsame line\n" + prose(20_000)
    assert len(long) > B.STEP_BYTES
    texts = [long, prose(100) + " " + shared, long[:-50], *[hot] * 20, *[prose(rng.randint(5, 80)) for _ in range(37)]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, drop_repeats(docs).collect())) == windows_brute(rows)
    out = quality_table(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, out.collect())) == quality_brute(rows)
    out = drop_frequent_lines(docs).select("doc_id", "__n_lines", "__n_dropped", F.sha2("text", 256))
    assert sorted(map(tuple, out.collect())) == lines_brute(rows)
    out = simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert {r[0]: (r[1], r[2]) for r in out} == components_brute(rows)
    got = {r.doc_id: r for r in fingerprint_with_edits(docs).collect()}
    assert all(got[i].fingerprint == simhash_texts([t.encode()])[0].tobytes().hex() and got[i].n_chars == len(t) for i, t, *_ in rows)
    pieces = pack(docs).collect()
    assert sum(r.doc_id == 0 for r in pieces) > 1 and {r.doc_id for r in pieces} == set(range(len(rows)))
    assert len({r.ids_crc32 for r in pieces if 3 <= r.doc_id < 23}) == 1


def test_rows_without_ids_or_with_the_same(spark):
    """Values, not only counts, where ids are null or repeated and columns clash."""
    from heronry.llm.fingerprints import fingerprint_with_edits
    from heronry.llm.near_simhash import simhash_components
    from heronry.llm.packing import pack
    from heronry.llm.suffix_trees import drop_repeats

    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, long, "en", "s", 3), (1, long, "en", "s", 3), (1, "c d", "en", "s", 3), (None, long, None, None, 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "k1", "k2", "key", "part", "kind", "pack", "host", "fp", "bucket", "n", "size", "sequence", "lists"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in drop_repeats(docs).collect()) == [(1, 2, 0), (1, 30, 0), (1, 30, 0), (9, 0, 0), (9, 30, 30)]
    groups = simhash_components(docs).collect()
    assert sorted((r.doc_id or 9, r.component_id or 9) for r in groups) == [(1, 1), (1, 1), (1, 1), (9, 1), (9, 9)]
    assert sorted((r.doc_id or 9, r.n_chars) for r in fingerprint_with_edits(docs).collect()) == [(1, 3), (1, len(long)), (1, len(long)), (9, 0), (9, len(long))]
    assert sorted((r.doc_id or 9, r.piece) for r in pack(docs).collect()) == [(1, 0), (1, 0), (1, 0), (9, 0), (9, 0)]


def test_classifier_scores_by_brute_force(spark):
    """Scores of a model against sums over each text's words and character grams, ties at the threshold, equal ids, null texts."""
    from heronry.llm import classifier as Q

    rng = np.random.default_rng(4)
    model = Q.Model(rng.normal(size=Q.BUCKETS + 2).astype(np.float32), 0.25)
    texts = ["one", "Two words here", "", None, "ß é " * 9, "one"]
    docs = spark.createDataFrame([(min(i, 4), t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Q.score(docs, model).collect()
    for t in texts:
        pairs = [(int(b), int(d)) for buckets, owner in Q._features([t or ""]) for b, d in zip(buckets, owner)]
        z = (sum(float(model.table[b]) for b, _ in pairs) / max(1, len(pairs))) + 0.25
        assert any(r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) for r in got), t
    assert len(got) == len(texts) and len({round(r.score, 9) for r in got if r.doc_id in (2, 3)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = Q.score_quality(docs, none, threshold=0.5).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in flat)  # a score at the threshold predicts 1
    assert all(r.predicted == 0 for r in Q.score_quality(docs, none, threshold=0.7).collect())


def quality_features(text, buckets):
    """Buckets of a text's words, repeats and character grams, written anew in whole numbers."""
    full = (1 << 64) - 1

    def mix(x):
        x &= full
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    base = 0x9E3779B97F4A7C15
    line = " " + re.sub(BLANK, " ", text) + " "
    hashes = [mix(sum(mix(ord(c)) * pow(base, i, 1 << 64) for i, c in enumerate(w))) for w in line.split(" ") if w]
    out = [h % buckets for h in hashes]
    out += [buckets for a, b in zip(hashes, hashes[1:]) if a == b] + [buckets + 1 for a, b in zip(hashes, hashes[2:]) if a == b]
    for n in (3, 4):
        for i in range(len(line) - n + 1):
            if " " not in line[i + 1 : i + n - 1]:
                h = 0
                for c in line[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) & full
                out.append(mix(h + (n << 32)) % buckets)
    return out


def test_quality_scores_by_features_written_anew(spark, docs, rows):
    """Each row's score by its id: odd blanks, repeats, characters beyond ASCII, texts beyond one array step, null texts."""
    from heronry.llm import classifier as Q

    rng = np.random.default_rng(4)
    model = Q.Model(rng.normal(size=Q.BUCKETS + 2).astype(np.float32), 0.25)
    more = [(900 + i, t, "en", "s", 0) for i, t in enumerate(["a a b a", "\u00df \U0001f600x " * 9, "x" * 5, " \x0b ", "word \x85 \u2003y " * 30_000])]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = {r.doc_id: r.score for r in Q.score(both, model).collect()}
    table = model.table.astype(np.float64)
    for i, t, *_ in rows + more:
        found = quality_features(t or "", Q.BUCKETS)
        z = table[found].sum() / max(1, len(found)) + 0.25
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6), (i, t and t[:20])
    assert len(got) == len(rows) + len(more)


def test_lines_of_a_long_text_take_time_in_proportion(spark):
    """Texts of 5,000 and of 40,000 lines, every second one frequent: values, and no square of the lines in the time."""
    import time

    from heronry.llm.lines import drop_frequent_lines

    took = {}
    for n in (5_000, 40_000):
        text = "\n".join(f"line {k}" if k % 2 else f"own {n} {k} text" for k in range(n))
        data = [(i, text, "en", "s", 0) for i in range(10)] if n < 10_000 else [(0, text, "en", "s", 0)] + [(i, "\n".join(f"line {k}" for k in range(1, n, 2)), "en", "s", 0) for i in range(1, 10)]
        df = spark.createDataFrame(data, SCHEMA).repartition(4)
        began = time.time()
        out = sorted(map(tuple, drop_frequent_lines(df).select("doc_id", "__n_lines", "__n_dropped", F.sha2("text", 256)).collect()))
        took[n] = time.time() - began
        assert out == lines_brute(data)
    assert took[40_000] < 8 * took[5_000] + 30, took


def test_long_and_hot_texts_of_the_other_operators(spark):
    """Secrets, passages and draws of a text beyond one array step, and of one that a third of all rows hold."""
    from heronry.llm.mixing import mix_sources
    from heronry.llm.secret_crf import find_secrets
    from heronry.llm.sparse_suffixes import repeated_passages

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    hot = " ".join(word() for _ in range(80))
    long = " ".join(f"token = {word()}{rng.randrange(10**6)}" if k % 97 == 0 else word() for k in range(60_000))
    texts = [hot] * 40 + [long, " ".join(word() for _ in range(60)) + " " + " ".join(long.split(" ")[30_000:30_070])] + [" ".join(word() for _ in range(70)) for _ in range(78)]
    data = [(i, t, "en", "hot" if t == hot else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6).cache()
    found = {r.doc_id: r for r in find_secrets(df, sample=50).collect()}
    for i, t, *_ in data:
        base = secrets_brute(t)
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert found[40].n_assign > 500
    spans = {}
    for r in repeated_passages(df, least=50).collect():
        spans.setdefault(r.doc_id, []).append(r)
    assert set(range(40)) <= set(spans) and {40, 41} <= set(spans) and not set(spans) - set(range(42))
    drawn = Counter(r.doc_id for r in mix_sources(df).select("doc_id").collect())
    assert set(drawn) <= {i for i, *_ in data} and sum(drawn.values()) > 0
