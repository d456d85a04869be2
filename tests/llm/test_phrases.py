"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(a for g, a in counts.items() if len(g) == 1)
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            longer = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if longer and 100 * max(longer) >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def corpus(n=300, seed=8):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "straße", "A\x85b", "to", "be", "or"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    texts = [None, "", " \t", "...", "one", "To be, or not to be: TO BE"]
    fixed = ["not to be confused", "in spite of", "new york city council", "a a a a a", "heron heron"]
    for _ in range(n):
        words = rng.choices(vocab, weights, k=rng.randrange(1, 60))
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "\x1c"]) for w in words))
    return [(i, t, rng.choice(["en", "en", "de", None, "und"])) for i, t in enumerate(texts)]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("least", "top", "hot", "pack"), [(5, 2000, P.HOT, P.PACK), (3, 25, 20, 300)])
def test_collocations(spark, least, top, hot, pack):
    """Also with hot pivots in many parts, packs of a few texts, and texts cut at breaks."""
    rows = corpus()
    want = brute(rows, least, top)
    assert got(P.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, top=top, hot=hot, pack=pack)) == want
    assert len(want) > 60


def test_each_ngram_reaches_one_partition_once():
    rng = np.random.default_rng(1)
    ranks = rng.integers(1, 9, 4000)
    ranks[rng.random(4000) < 0.1] = P._NONE
    mine, plain = Counter(), Counter()
    for f in P._around(ranks).T.tolist():
        left, p, right = [x for x in f[:3] if x], f[3], [x for x in f[4:] if x]
        for i in range(len(left) + 1):
            for j in range(len(right) + 1):
                if 1 <= i + j <= 3:
                    mine[tuple(left[len(left) - i :] + [p] + right[:j])] += 1
    for k in (2, 3, 4):
        for i in range(len(ranks) - k + 1):
            if (ranks[i : i + k] < P._NONE).all():
                plain[tuple(ranks[i : i + k].tolist())] += 1
    assert mine == plain


def test_a_long_text_and_a_hot_pair(spark):
    rows = [(1, "of the " * 60_000 + ". x y", "en"), (2, "of the", "en"), (3, "abc" * 200_000, "en")] + [(i, "of the heron. of the", "fr") for i in range(4, 400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(P.collocations(df, hot=1000, pack=50_000)) == brute(rows, 30, 2000)


def test_products_beyond_64_bits(spark):
    a = 5_000_000_000_000_000
    gram = lambda *w: [(w + (0,) * 4)[0] << 32 | (w + (0,) * 4)[1], (w + (0,) * 4)[2] << 32 | (w + (0,) * 4)[3], len(w)]
    counts = spark.createDataFrame([[*gram(1), 3 * a], [*gram(2), 2 * a + 7], [*gram(1, 2), a]], "g1 long, g2 long, size int, a long")
    (row,) = P._scored(counts).collect()
    assert row.score == 2000000 * a // (5 * a + 7) and (row.l, row.r) == (3 * a, 2 * a + 7)


def test_odd_tables(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None, None)] * 3, SCHEMA)).count() == 0
    rows = [(1, "a b", None)] * 40 + [(None, "a b", "und")] * 2
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("rank", "word", "f", "g1", "owner", "pack", "n", "a", "i"):
        clash = clash.withColumn(name, F.lit("x"))
    assert got(P.collocations(clash)) == brute(rows, 30, 2000) == [("und", 1, "a b", 42, 42, 42, 84, 1000000)]
