"""Collocations, mined by pivot partitioning.

Words are counted first and ranked, the most frequent one first. An n-gram belongs to its rarest word, its pivot. Each
occurrence of a word sends the fragment of up to three words on either side to that word's partition, as far as the
words are more frequent than it (on the right also the word itself); rarer words end a fragment, for an n-gram across
them belongs to another pivot. So each occurrence of an n-gram reaches exactly one partition once, at the leftmost place
of its rarest word, and a partition counts and prunes its n-grams without asking another.

Words with few occurrences end fragments too: no frequent phrase has them. Pivots with more than ``HOT`` occurrences are
dealt out in parts by their fragments, and the parts' counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.store import small_batches, written
from heronry.operators.tables import ranked
from heronry.shared import spread

#: Bytes of text in a pack.
PACK = 2_000_000
#: Occurrences of a pivot in one partition.
HOT = 1 << 17
#: Words of the longest phrase.
LONGEST = 4
#: Groups that the first rows of a language are taken from.
SALTS = 64

_BREAK = 10
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_FOLD[9] = 32
_NONE = np.int32((1 << 31) - 1)


# --- packs


def _cuts(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buffers of about ``size`` bytes, with offsets; a longer text is cut at breaks, where no phrase goes on."""
    stops = np.union1d(offsets, np.flatnonzero(data == _BREAK) + 1)
    at = 0
    while at < len(data):
        end = int(stops[max(np.searchsorted(stops, at + size, "right") - 1, np.searchsorted(stops, at, "right"))])
        inner = offsets[(offsets > at) & (offsets < end)]
        yield data[at:end], np.concatenate(([0], inner - at, [end - at]))
        at = end


def _found(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start and end of each word of a buffer, and whether it begins a piece; a step at a time."""
    parts, at = [], 0
    for part, own in _cuts(data, offsets, B.STEP_BYTES):
        starts, ends, doc = B.words(part, own)
        piece = np.searchsorted(np.flatnonzero(part == _BREAK), starts)
        new = np.append(True, (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]))[: len(starts)]
        parts.append((B.span_hashes(part, starts, ends), (starts + at).astype(np.int64), (ends + at).astype(np.int64), new))
        at += len(part)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray] | None:
    """(tokens, words, counts) of a buffer of folded bytes; a token is a word's place + 1, 0 ends a piece."""
    hashes, starts, ends, new = _found(data, offsets)
    if not len(hashes):
        return None
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    new[0] = False
    tokens = np.zeros(len(starts) + int(new.sum()), np.int32)
    tokens[np.arange(len(starts)) + np.cumsum(new)] = place[inverse]
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts[first[order]].tolist(), ends[first[order]].tolist(), strict=True)]
    return tokens, words, counts[order]


def _packs(docs: DataFrame, size: int) -> DataFrame:
    """(pack, lang, tokens, words, counts): the words of some texts of a language, as places in their own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                texts = batch.column(1).filter(pc.equal(langs, lang))
                for _, _, data, offsets in B.pieces(texts, 4 * size):
                    for part, own in _cuts(_FOLD[data], offsets, size):
                        found = _tokens(part, own)
                        if found is None:
                            continue
                        tokens, words, counts = found
                        small = tokens.astype("<u2" if len(words) < 1 << 16 else "<u4")
                        n += 1
                        yield pa.RecordBatch.from_pydict({
                            "pack": pa.array([task << 32 | n]), "lang": pa.array([lang]), "wide": pa.array([small.itemsize], pa.int32()), "tokens": pa.array([small.tobytes()], pa.binary()),
                            "words": pa.array([words], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int64())),
                        })

    return docs.mapInArrow(run, "pack long, lang string, wide int, tokens binary, words array<string>, counts array<long>")


# --- fragments


def _around(ranks: np.ndarray) -> np.ndarray:
    """(7, fragments): for each word with a neighbour to take along, up to three words before, it, up to three after.

    ``ranks``: a rank from 1 for each token, _NONE where a piece ends or a word is rare; 0 stands for no word.
    """
    r = np.concatenate(([_NONE] * 3, ranks, [_NONE] * 3)).astype(np.int32)
    n = len(ranks)
    p = r[3 : 3 + n]
    with_any = (p < _NONE) & ((r[2 : 2 + n] < p) | (r[4 : 4 + n] <= p))
    at = np.flatnonzero(with_any) + 3
    out = np.zeros((7, len(at)), np.int32)
    p = out[3] = r[at]
    for side, limit in ((-1, p - 1), (1, p)):
        live = np.ones(len(at), bool)
        for step in (1, 2, 3):
            word = r[at + side * step]
            live &= word <= limit
            out[3 + side * step] = np.where(live, word, 0)
    return out


def _merged(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments once each, in the order of their pivots; how often; a hash of each."""
    h = np.zeros(f.shape[1], np.uint64)
    for j in range(7):
        h = B.mix(h + f[j].astype(np.uint64) + np.uint64(j + 1))
    order = np.argsort(h)
    f, h = f[:, order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (f[:, 1:] != f[:, :-1]).any(axis=0))[: len(h)]
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    order = np.lexsort((f[2, at], f[4, at], f[3, at]))  # neighbours alike: rows that follow each other take fewer bytes
    return f[:, at[order]], weight[order], h[at[order]]


def _fragments(packs: DataFrame, frequent: DataFrame, hot: int) -> DataFrame:
    """(owner, x, y, z, w): a pivot's fragments with their weight; two ranks to a number. A hot pivot's owner is negative."""
    places = packs.select("pack", "lang", F.posexplode("words").alias("i", "word"))
    parts = F.ceil(F.col("f") / hot).cast("int").alias("parts")
    known = places.join(frequent.select("lang", "word", F.col("rank").cast("int").alias("rank"), parts), ["lang", "word"]).groupBy("pack").agg(F.collect_list(F.struct("i", "rank", "parts")).alias("k"))
    held = packs.select("pack", "wide", "tokens", F.size("words").alias("n")).join(known, "pack").select("wide", "tokens", "n", "k.i", "k.rank", "k.parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                wide, tokens, n = (batch.column(c)[row] for c in range(3))
                i, rank, parts = (batch.column(c)[row].values.to_numpy() for c in range(3, 6))
                table = np.full(n.as_py() + 1, _NONE)
                table[i + 1] = rank
                fragments, weight, h = _merged(_around(table[np.frombuffer(tokens.as_buffer(), f"<u{wide.as_py()}")]))
                pivot = fragments[3].astype(np.int64)
                order = np.argsort(rank)
                split = parts[order][np.searchsorted(rank[order], pivot)].astype(np.uint64)
                owner = np.where(split > 1, -1 - ((h % split).astype(np.int64) << 32 | pivot), pivot)
                two = lambda a, b: pa.array(fragments[a].astype(np.int64) << 32 | fragments[b])  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"owner": pa.array(owner), "x": two(0, 1), "y": two(2, 4), "z": two(5, 6), "w": pa.array(weight.astype(np.int64))})

    return held.mapInArrow(run, "owner long, x long, y long, z long, w long")


def _pair(a: Column | int, b: Column | int) -> Column:
    """Two ranks in a number."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))
    return F.shiftleft(a, 32).bitwiseOR(b)


def _gram(words: list[Column]) -> Column:
    """An n-gram as two numbers."""
    four = [*words, *[0] * (LONGEST - len(words))]
    return F.struct(_pair(four[0], four[1]).alias("g1"), _pair(four[2], four[3]).alias("g2"))


def _mined(fragments: DataFrame, least: int) -> DataFrame:
    """(g1, g2, a): n-grams of two words or more that occur ``least`` times or more."""
    low = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    high = lambda c: F.shiftright(c, 32)
    pivot = F.when(F.col("owner") < 0, (-1 - F.col("owner")).bitwiseAND(0xFFFFFFFF)).otherwise(F.col("owner"))
    f = fragments.repartition("owner").select("owner", "w", pivot.alias("p"), high("x").alias("l3"), low("x").alias("l2"), high("y").alias("l1"), low("y").alias("r1"), high("z").alias("r2"), low("z").alias("r3"))
    left, right = [F.col(c) for c in ("l1", "l2", "l3")], [F.col(c) for c in ("r1", "r2", "r3")]
    grams = []
    for i in range(LONGEST):
        for j in range(LONGEST - i):
            if i + j:
                there = F.lit(True)
                if i:
                    there = there & (left[i - 1] > 0)
                if j:
                    there = there & (right[j - 1] > 0)
                grams.append(F.when(there, _gram([*left[:i][::-1], F.col("p"), *right[:j]])))
    each = f.select("owner", "w", F.explode(F.array(*grams)).alias("g")).where("g IS NOT NULL").select("owner", "w", "g.g1", "g.g2")
    local = each.groupBy("owner", "g1", "g2").agg(F.sum("w").alias("a")).where((F.col("owner") < 0) | (F.col("a") >= least))
    return local.groupBy("g1", "g2").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# --- scores


def _words(g1: str = "g1", g2: str = "g2") -> list[Column]:
    return [F.shiftright(g1, 32), F.col(g1).bitwiseAND(0xFFFFFFFF), F.shiftright(g2, 32), F.col(g2).bitwiseAND(0xFFFFFFFF)]


def _scored(counts: DataFrame) -> DataFrame:
    """(g1, g2, a, l, r, score) of phrases that no longer phrase replaces. ``counts``: (g1, g2, size, a), words among them."""
    w = [F.element_at("ws", k + 1) for k in range(LONGEST)]
    many = counts.where("size > 1").withColumn("ws", F.array(*_words()))
    by_size = lambda make: F.when(F.col("size") == 2, make(2)).when(F.col("size") == 3, make(3)).otherwise(make(4))
    cuts = lambda m: F.array(*[F.struct(F.lit(k).alias("k"), _gram(w[:k]).alias("p"), _gram(w[k:m]).alias("q")) for k in range(1, m)])
    cut = many.select("g1", "g2", "a", F.explode(by_size(cuts)).alias("c")).select("g1", "g2", "a", "c.k", F.col("c.p.g1").alias("p1"), F.col("c.p.g2").alias("p2"), F.col("c.q.g1").alias("q1"), F.col("c.q.g2").alias("q2"))
    side = lambda x, name: counts.select(F.col("g1").alias(f"{x}1"), F.col("g2").alias(f"{x}2"), F.col("a").alias(name))
    both = cut.join(side("p", "l"), ["p1", "p2"]).join(side("q", "r"), ["q1", "q2"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = both.groupBy("g1", "g2", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    inner = lambda m: F.array(*[_gram(w[a:b]) for a in range(m) for b in range(a + 2, m + 1) if b - a < m])
    longer = many.where("size > 2").select(F.explode(F.when(F.col("size") == 3, inner(3)).otherwise(inner(4))).alias("s"), "a").groupBy("s.g1", "s.g2").agg(F.max("a").alias("longer"))
    out = lowest.join(longer, ["g1", "g2"], "left")
    kept = F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(80).cast("decimal(3,0)") * F.col("a"))
    return out.where(kept).select("g1", "g2", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, hot: int = HOT, pack: int = PACK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    A-Z are lowered; ``.,;:!?`` and line ends break texts into pieces, blanks and tabs pieces into words; a phrase lies
    in a piece and occurs ``least`` times or more. Its score is the lowest of floor(2000000 a / (l + r)) over its cuts,
    where l and r count its two sides (the first such cut). A phrase goes if a longer one that holds it has 80 % of its
    occurrences. Order: score, then a, descending, then the phrase by its bytes.

    Defined cases: a null language is ``und``, and so is one with that name; a null or empty text has no words; rows are
    counted each, whatever their ids; a text of any length is cut into packs at its breaks; an empty table, or one
    without frequent phrases, gives an empty table; other columns are left out. More than 2^31 frequent words are an
    error.

    Packs are written once and hold word numbers, not texts. Ranks come back to packs through a join on words, so no
    task holds the vocabulary. Fragments of a pack are merged before the shuffle, and counted by hash aggregation, which
    spills. The last limit is taken within ``SALTS`` groups of a language first.
    """
    small_batches(docs.sparkSession, "8m")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    packs = written(_packs(spread(docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))), pack), "phrase-packs")
    counted = packs.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    counted = written(counted, "phrase-words")
    sizes = written(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-sizes")
    rank = F.col("rank") + 1
    checked = F.when(rank >= (1 << 31) - 1, F.raise_error(F.lit("more than 2^31 frequent words")).cast("long")).otherwise(rank)
    frequent = written(ranked(counted.where(F.col("f") >= least), [F.desc("f"), F.asc("lang"), F.asc("word")]).withColumn("rank", checked), "phrase-ranks")
    mined = _mined(_fragments(packs, frequent, hot), least)
    g = _words()
    size = F.when(g[2] == 0, 2).when(g[3] == 0, 3).otherwise(4)
    single = frequent.select(_gram([F.col("rank")]).alias("g"), F.col("f").alias("a")).select("g.g1", "g.g2", F.lit(1).alias("size"), "a")
    counts = written(mined.select("g1", "g2", size.alias("size"), "a").unionByName(single), "phrase-counts")
    spelt = _scored(counts).select("*", F.posexplode(F.filter(F.array(*_words()), lambda v: v > 0)).alias("i", "v")).join(frequent.select(F.col("rank").alias("v"), "lang", "word"), "v")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ")
    rows = spelt.groupBy("g1", "g2", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), phrase.alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = rows.withColumn("salt", salt).withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
