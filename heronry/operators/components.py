"""Reconstruction error of windows by their principal components: a linear autoencoder.

Sums, sums of products and counts of windows are taken block by block and add up, so a series of any length is fitted
without being gathered; the eigenvectors are of a matrix of window length squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.forest import _edges
from heronry.operators.models import _blocks, _layout_of
from heronry.operators.series import fit_part
from heronry.shared import dealt


def component_fit(series: DataFrame, layouts: DataFrame, *, share: float = 0.9, most: int | None = None, on: str = "train", block: int = 4096) -> DataFrame:
    """(series_id, w, mean, axes, kept): the mean window and the leading axes that hold ``share`` of the variance.

    At least one axis is kept, at most ``most``, and fewer than a window has points. Constant training windows keep none.
    Blocks of windows are summed by themselves, and the sums of a series added up; a shift by the series' first value keeps
    the products small. Axes are signed so that their largest entry is positive.
    """
    id_type = series.schema["series_id"].dataType.simpleString()
    train = fit_part(series, layouts, on)
    shift = train.groupBy("series_id").agg(F.min_by("x", "idx").alias("shift"))
    blocks = _blocks(train, layouts.select("series_id", "w"), block).join(shift, "series_id")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                v = np.lib.stride_tricks.sliding_window_view(np.asarray(r.part, float) - r.shift, int(r.w))
                yield pd.DataFrame({"series_id": [r.series_id], "w": [int(r.w)], "shift": [r.shift], "n": [len(v)], "sums": [v.sum(axis=0).tolist()], "products": [(v.T @ v).ravel().tolist()]})

    parts = dealt(blocks, "series_id", "first").mapInPandas(summed, f"series_id {id_type}, w long, shift double, n long, sums array<double>, products array<double>")
    # array entries add up by place: partial sums on each side of the shuffle, and no task holds the blocks of a series
    entries = parts.select("series_id", "w", "shift", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "sums", "products")).alias("place", "v"))
    added = entries.groupBy("series_id", "w", "shift", "place").agg(F.sum("v").alias("v"))
    whole = added.groupBy("series_id", "w", "shift").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda p: p["v"]).alias("all"))

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                w, a = int(r.w), np.asarray(r.all, float)
                n, sums, products = a[0], a[1 : 1 + w], a[1 + w :].reshape(w, w)
                mean = sums / n
                values, vectors = np.linalg.eigh(products / n - np.outer(mean, mean))
                values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
                total = values.sum()
                kept = 0 if total <= 1e-12 * max(1.0, float(np.abs(products / n).max())) else 1 + int(np.searchsorted(np.cumsum(values) / total, share - 1e-12))
                kept = min(kept, w - 1, most if most is not None else w)
                lead = vectors[:kept]
                lead = lead * np.sign(lead[np.arange(kept), np.abs(lead).argmax(axis=1)])[:, None]
                yield pd.DataFrame({"series_id": [r.series_id], "w": [w], "mean": [(mean + r.shift).tolist()], "axes": [lead.ravel().tolist()], "kept": [kept]})

    return whole.mapInPandas(axes, f"series_id {id_type}, w long, mean array<double>, axes array<double>, kept int")


def component_scores(series: DataFrame, fitted: DataFrame, *, block: int = 4096) -> DataFrame:
    """(series_id, idx, score): root of the squared distance of a window to the span of the axes, at its middle."""
    id_type = series.schema["series_id"].dataType.simpleString()
    widths = fitted.select("series_id", "w")
    blocks = _blocks(series, widths, block).join(fitted.drop("w"), "series_id")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                w = int(r.w)
                v = np.lib.stride_tricks.sliding_window_view(np.asarray(r.part, float), w) - np.asarray(r.mean, float)
                a = np.asarray(r.axes, float).reshape(-1, w)
                rest = v - (v @ a.T) @ a
                yield pd.DataFrame({"series_id": r.series_id, "start": np.arange(r.first, r.first + len(v)), "v": np.sqrt((rest * rest).sum(axis=1))})

    dist = dealt(blocks, "series_id", "first").mapInPandas(measured, f"series_id {id_type}, start long, v double")
    return _edges(dist, _layout_of(series, widths))
