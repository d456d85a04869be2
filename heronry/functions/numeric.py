"""Scalar functions as Column expressions. Undefined results are NULL, never NaN and never 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Normal quantile of the two-sided 95 % interval.
Z95 = 1.959963984540054


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0 or either is NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def r6(x: Column) -> Column:
    """Rounded to six places, as double."""
    return F.round(x.cast("double"), 6)


def scaled_round(x: Column, places: int) -> Column:
    """Rounded by scaling: the product is rounded, halves away from zero, and scaled back, as DuckDB rounds doubles.

    Spark's own rounding goes by a double's decimal digits, which may show a half where the product is below or above it.
    """
    scale = F.lit(10.0**places)
    return F.round(x.cast("double") * scale, 0) / scale


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def region_length(fraction: Column | float, w: Column) -> Column:
    """max(1, floor(fraction * w + 1/2))."""
    f = F.lit(fraction) if isinstance(fraction, float) else fraction
    return F.greatest(F.lit(1).cast("long"), round_half_up(f * w))


def to_half_open(begin: Column, end: Column, convention: str) -> tuple[Column, Column]:
    """0-based half-open interval from a stated convention; an unknown one is an error, not a guess."""
    shift = {"one_based_inclusive": (1, 0), "zero_based_inclusive": (0, 1), "zero_based_half_open": (0, 0)}
    if convention not in shift:
        raise ValueError(f"unknown index convention {convention!r}; one of {sorted(shift)}")
    a, b = shift[convention]
    return begin - a, end + b


def from_half_open(start: Column, stop: Column, convention: str) -> tuple[Column, Column]:
    a, b = to_half_open(start, stop, convention)
    return start + (start - a), stop - (b - stop)


def fisher_mean(r: Column) -> Column:
    """Mean of correlations on Fisher's scale; NULLs are skipped, |r| is held at 0.999999."""
    return F.tanh(F.avg(F.atanh(F.least(F.greatest(clean(r), F.lit(-0.999999)), F.lit(0.999999)))))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson 95 % interval, held to [0, 1]; NULL for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    z2 = F.lit(Z95 * Z95)
    mid = (p + z2 / (n * 2)) / (F.lit(1.0) + z2 / n)
    half = F.lit(Z95) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (n * n * 4)) / (F.lit(1.0) + z2 / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def composite(mean: Column, share: Column) -> Column:
    """0 if mean * share <= 0, else the harmonic mean of the magnitudes."""
    return F.when(mean * share <= 0, F.lit(0.0)).otherwise(F.lit(2.0) / (F.lit(1.0) / F.abs(mean) + F.lit(1.0) / F.abs(share)))


def sign_type(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), "zero").when((a > 0) & (b > 0), "(+,+)").when((a < 0) & (b < 0), "(-,-)").otherwise("conflict")


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """|a - b| within the tolerance, relative or absolute, whichever is larger."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def printed_match(value: Column, printed: Column, decimals: Column) -> Column:
    """Whether a value rounds to what was printed with so many decimals."""
    return F.abs(value - printed) <= F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + F.lit(1e-12)


def portable_random(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of md5 of the parts: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / F.lit(281474976710656.0)


def average_rank(value: Column, keys: Sequence[Column | str], *, descending: bool = True) -> Column:
    """Mean of the ranks that equal values share within ``keys``; 1 for the largest."""
    order = value.desc() if descending else value.asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / F.lit(2.0)
