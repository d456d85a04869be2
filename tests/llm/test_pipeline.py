"""The pipeline against a brute-force version of its stages."""

import hashlib
from math import exp

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_llm import SCHEMA, components_brute, corpus, quality_brute, words
from tokenizers import Tokenizer

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    kept = {r[0] for r in quality_brute(rows) if r[-1]}
    rows = [r for r in rows if r[0] in kept]
    low = {c: c + 32 for c in range(65, 91)}
    held = {}
    for i, t, *_ in rows:
        for line in t.split("\n"):
            held.setdefault(line.strip(BLANKS).translate(low), set()).add(i)
    common = {k for k, ids in held.items() if k and len(ids) >= 10}
    rows = [(i, "\n".join(x for x in t.split("\n") if x.strip(BLANKS).translate(low) not in common), s) for i, t, _, s, _ in rows]
    groups = components_brute(rows)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    mass = {}
    for _, t, s in rows:
        mass[s] = mass.get(s, 0) + max(len(t), 1)
    root, total = sum(m**0.5 for m in mass.values()), sum(mass.values())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t, s in rows:
        rate = mass[s] ** 0.5 / root * total / mass[s]
        u = (int(hashlib.md5(f"42:{i}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, exp(-rate)
        c = p
        while u > c:
            k += 1
            p = p * rate / k
            c += p
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        out += [(i, q, 2048 * q, min(2048, n - 2048 * q)) for q in range(-(-n // 2048))] * k
    return sorted(out)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    line = "the very same line of words stands in many documents"
    rows = [(i, f"{t}\n{line}" if t and len(words(t)) > 40 else t, lang, s) for i, t, lang, s, _ in corpus(150, seed=9)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in out) == brute(rows)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_first_stage_removes_lines_over_the_limit(spark):
    """A line in 12 documents of a host, 5 of them rejected: the other 7 lose it though fewer than ten hold it then."""
    import corpus_pipeline

    line = "Read more on  our site"
    rows = []
    for i in range(12):
        own = " ".join(f"w{i}x{k}" for k in range(25 if i < 7 else 5))
        text = f"{own}\n \n{line.upper() if i % 2 else line} \nlast é line {i}"
        rows.append((i, text, "en", "s", len(text)))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert sorted(out) == list(range(7))
    for i, r in out.items():
        own = rows[i][1].split("\n")
        assert r.text == "\n".join([own[0], own[1], own[3]]) and r.n_chars == len(r.text)


def test_stages_take_odd_tables(spark):
    """Nulls in any column, repeated rows and ids, ties, and columns whose names are used inside."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, None, None, None), (None, c, "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0), (6, a, "en", "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ("host", "k1", "k2", "fp", "key", "n", "bad", "rate", "size", "sequence", "part", "bucket", "row", "line", "a", "b")
    for name in names:
        docs = docs.withColumn(name, F.lit("x"))
    stage = dict(corpus_pipeline.STAGES)
    seen = lambda d: sorted((r.doc_id or 0, r.text or "") for r in d.collect())
    all_ = [(0, ""), (0, c), (1, a), (1, a), (1, b), (5, ""), (6, a)]
    want = {"quality rules": [(0, c), (1, a), (1, a), (1, b), (6, a)], "line dedup": all_, "near dedup": [(0, c), (1, a), (1, b), (5, "")]}
    for name, rows_ in want.items():
        out = stage[name](spark, docs, "")
        assert seen(out) == rows_, name
        assert out.columns == docs.columns and all(r[n] == "x" for r in out.collect() for n in names), name
    mixed = stage["mixing"](spark, docs, "").collect()
    assert {(r.doc_id or 0, r.text or "") for r in mixed} <= set(all_) and all(r[n] == "x" for r in mixed for n in names)
    counts = {}
    for r in mixed:
        if (r.doc_id, r.source) == (1, "s"):
            counts[r.text] = counts.get(r.text, 0) + 1
    assert all(n % 2 == 0 for n in counts.values())  # rows of one id and source are drawn alike
    packed = stage["packing"](spark, docs, "").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(((r.doc_id or 0), r.length) for r in packed) == sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in all_)
