"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character 3- and 4-grams of its words (with a blank
at either end), all hashed into buckets; two further words mark that a word repeats the one before it, or the one
before that. A softmax layer turns the mean into a probability. Vectors and layer are trained by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.

Because the layer is linear in the mean, a trained model is one number for each bucket and a bias. Scoring reads that
table for every feature of the whole text, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.store import small_batches
from heronry.shared import spread

BUCKETS = 1 << 17
#: Buckets of the two words that mark repetition.
_REPEATS = np.array([[BUCKETS], [BUCKETS + 1]])
GRAMS = (3, 4)
_U = np.uint64


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, documents) of each family of features, for documents in one array."""
    joined = "\n".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.concatenate(([0], np.cumsum(size)))  # of the blank before each text
    low = np.minimum(points, 255).astype(np.uint8)
    blank = B._SPACE[low]
    wide = np.where(blank, 32, points).astype(_U)

    def owner(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(first, at, "right") - 1

    edges = np.diff(blank.astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    doc = owner(starts)
    up, down = B._IN_WORD.get(len(points) + 1)
    total = np.zeros(len(points) + 1, _U)
    np.cumsum(B.mix(wide) * up[:-1], out=total[1:])
    hashes = B.mix((total[ends] - total[starts]) * down[starts])
    yield (hashes % _U(BUCKETS)).astype(np.int64), doc
    for back, bucket in zip((1, 2), _REPEATS, strict=True):
        again = np.flatnonzero((hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])) + back
        yield np.full(len(again), bucket[0]), doc[again]
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, _U)
        inside = np.zeros(len(h), bool)
        for k in range(n):
            h = h * _U(0x100000001B3) + wide[k : k + len(h)]
            if 0 < k < n - 1:
                inside |= blank[k : k + len(h)]
        at = np.flatnonzero(~inside)
        yield (B.mix(h[at] + _U(n << 32)) % _U(BUCKETS)).astype(np.int64), owner(at)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for at, end, data, offsets in B.pieces(batch.column("text")):
        raw, edges = data.tobytes(), offsets.tolist()
        yield at, end, [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's buckets and their counts."""
    for batch in batches:
        for at, end, texts in _steps(batch):
            pairs = list(_features(texts))
            key = np.concatenate([d for _, d in pairs]) * (BUCKETS + 2) + np.concatenate([b for b, _ in pairs])
            key, n = np.unique(key, return_counts=True)
            cut = np.searchsorted(key, np.arange(len(texts) + 1) * (BUCKETS + 2))
            ids, n = (key % (BUCKETS + 2)).astype("<u4"), n.astype("<u4")
            columns = [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (ids, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), batch.column("label").slice(at, end - at), *columns], ["doc_id", "label", "ids", "n"])


class Model:
    """One number for each bucket, and a bias."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; of a text without a word, the one the bias gives."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, doc in _features(texts):
            total += np.bincount(doc, self.table[bucket], len(texts))
            n += np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], *, dim: int = 8, epochs: int = 8, rate: float = 0.3, seed: int = 0) -> Model:
    """Softmax over the mean vector, by SGD with step sizes that shrink with each bucket's own gradients."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS + 2, dim)) / dim
    layer, bias = rng.normal(0, 1, (dim, 2)), np.zeros(2)
    seen_v, seen_l, seen_b = np.full(BUCKETS + 2, 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share, label = bags[k]
            hidden = share @ vectors[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer @ error
            g = share[:, None] * back
            seen_v[ids] += (g * g).sum(axis=1)
            vectors[ids] -= rate * g / np.sqrt(seen_v[ids])[:, None]
            g = np.outer(hidden, error)
            seen_l += g * g
            layer -= rate * g / np.sqrt(seen_l)
            seen_b += error * error
            bias -= rate * error / np.sqrt(seen_b)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted to at most ``sample`` labelled documents, those with the least hash of their id.

    Rows whose label or id is null are left out; of several labels of an id the least counts. Without labelled
    documents the model scores 0.5. The sample's ids are broadcast: there are ``sample`` of them at most.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = narrow.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "label", "text").mapInArrow(_bags, f"doc_id {kind}, label int, ids binary, n binary").toArrow().sort_by("doc_id")
    bags = []
    for label, ids, n in zip(*(rows.column(c).to_pylist() for c in ("label", "ids", "n")), strict=True):
        n = np.frombuffer(n, "<u4")
        if len(n):
            bags.append((np.frombuffer(ids, "<u4").astype(np.int64), n / n.sum(), int(label == 1)))
    return train(bags) if bags else Model(np.zeros(BUCKETS + 2, np.float32), 0.0)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``; null and empty texts get the score of a text without features."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in _steps(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(model.score(texts))], ["doc_id", "score"])

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is 2 modulo 4; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels of held-out ids are never learned.

    Defined cases: null and empty texts score what the bias alone gives; a null id isn't held out and teaches nothing;
    rows with equal ids are scored each by its own text, and all of them are learned with the id's label; a score equal
    to ``threshold`` predicts 1; without labels every score is 0.5; an empty table gives an empty table; other columns of
    both tables are left out.
    """
    model = fit(docs, labels.where(~held_out(id_col)), sample=sample, id_col=id_col, text_col=text_col)
    out = score(docs, model, id_col=id_col, text_col=text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
