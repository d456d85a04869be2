"""Connected components of an edge table, by alternating stars.

Large stars link every larger neighbour of a node to its smallest; small stars link the smaller ones. Both are a
grouped minimum, which combines before its shuffle, and a join back. Rounds are written to the shared folder, end when
an edge set repeats, and number about the logarithm of the longest path. No neighbour list is ever collected. As soon as
there are few edges, a number that doesn't grow with the corpus, one task finds the roots of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.store import written


#: Edges that one task resolves, 16 bytes each.
LOCAL = 250_000


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges u-v, in memory."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        for side in (u, v):
            np.minimum.at(root, before[side], least)
            np.minimum.at(root, side, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges of one task."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
        sizes = np.cumsum([0, *(len(x) for p in parts for x in p)])
        u, v = (np.concatenate([at[sizes[2 * i + k] : sizes[2 * i + k + 1]] for i in range(len(parts))]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[local_roots(u, v, len(nodes))])], ["node", "root"])


def component_roots(edges: DataFrame, name: str = "stars", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node of its component.

    Nodes that no edge holds aren't listed. Edges that are null or a loop are ignored.
    """
    edges = written(edges.where("u <> v").select("u", "v"), name)
    seen = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now[0] <= LOCAL:
            return edges.repartition(1).mapInArrow(_solved, "node long, root long")
        if now == seen:
            break
        edges = written(_small_star(_large_star(edges)), name)
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
