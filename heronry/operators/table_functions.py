"""Detectors as table functions, for queries in SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from heronry.operators.profile import BLOCK, nearest


class ProfileScores:
    """Scores of the points of each series by its matrix profile.

    ``SELECT * FROM profile_scores(TABLE(points), mode)``: the table has series_id, idx, x, te and w, one row a point; it
    is dealt out by series and put in order by the function itself. The mode is 'ab_join' or 'self_join', by default the
    first. The result has series_id (of the table's type), idx and score: a window's distance at its middle, the smallest
    one at points without. Series shorter than a window, or without a reference window, have no rows.
    """

    @staticmethod
    def analyze(points: AnalyzeArgument, mode: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("the first argument is a table")
        missing = {"series_id", "idx", "x", "te", "w"} - set(points.dataType.names)
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        if mode is not None and mode.value not in ("ab_join", "self_join"):
            raise ValueError(f"unknown mode {mode.value!r}")
        schema = StructType().add("series_id", points.dataType["series_id"].dataType).add("idx", LongType()).add("score", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("series_id")], orderBy=[OrderingColumn("idx")])

    def __init__(self) -> None:
        self.x: list[float] = []
        self.last: tuple | None = None

    def eval(self, points, mode: str = "ab_join") -> None:
        self.x.append(points["x"])
        self.last = (points["series_id"], int(points["te"]), int(points["w"]), mode)

    def terminate(self) -> Iterator[tuple]:
        if self.last is None:
            return
        series_id, te, w, mode = self.last
        x = np.asarray(self.x, float)
        n, end = len(x) - w + 1, (te if mode == "ab_join" else len(x)) - w + 1
        if n < 1 or end < 1:
            return
        best = np.full(n, np.inf)
        for lo in range(0, n, BLOCK):
            for r0 in range(0, end, BLOCK):
                q, r = x[lo : min(lo + BLOCK, n) + w - 1], x[r0 : min(r0 + BLOCK, end) + w - 1]
                d, _ = nearest(q, r, w, first=lo, first_ref=r0, exclusion=-(-w // 4) if mode == "self_join" else None)
                best[lo : lo + len(d)] = np.minimum(best[lo : lo + len(d)], d)
        known = np.isfinite(best)
        if not known.any():
            return
        score = np.full(len(x), best[known].min())
        score[np.flatnonzero(known) + w // 2] = best[known]
        yield from ((series_id, i, float(s)) for i, s in enumerate(score))


def register(spark: SparkSession) -> None:
    """Make ``profile_scores`` known to the session's SQL."""
    spark.udtf.register("profile_scores", UserDefinedTableFunction(ProfileScores, returnType=None, name="profile_scores"))
