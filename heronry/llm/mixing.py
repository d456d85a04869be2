"""Poisson replication of documents to target source weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.store import written

#: Largest mean that one inversion takes; a larger mean is a sum of equal independent parts.
PART_MEAN = 32.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of a hash of ``parts``."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(281474976710656.0)


def _inverse(mean: Column, u: Column) -> Column:
    """The number of k with P(X <= k) < u: the inverse Poisson distribution, for a mean of at most PART_MEAN."""

    def found(v: Column) -> Column:
        mean, u = v["mean"], v["u"]
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

        def step(s: Column, i: Column) -> Column:
            p = s["p"] * mean / i
            return F.when(u > s["c"], F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["c"] + p).alias("c"))).otherwise(s)

        # beyond this bound less probability is left than one step of u
        most = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(20.0)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])

    # as elements of an array mean and u are evaluated once, not at each step
    return F.get(F.transform(F.array(F.struct(mean.alias("mean"), u.alias("u"))), found), 0)


def poisson_count(mean: Column, seed: int, *key: Column) -> Column:
    """A Poisson count with the given mean, fixed by the seed and the key."""
    parts = F.greatest(F.lit(1), F.ceil(mean / F.lit(PART_MEAN)).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: _inverse(mean / parts, uniform(F.lit(seed), *key, i)))
    return F.when(mean > 0, F.aggregate(draws, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))


def source_rates(docs: DataFrame, *, exponent: float = 0.5, weights: Mapping[str, float] | None = None, size: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Mean repetitions of a document of each source: (__source, __rate).

    A source's mass is its code points, one at least for each document. Its target share is ``weights[source]`` over the
    sum of weights of sources present, or else mass ** exponent over the sum of that. ``size`` is the mass of the
    result over the mass of the input. The null source is a source.
    """
    mass = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(F.greatest(F.char_length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1))).cast("double").alias("m"))
    if weights is None:
        want = F.pow(F.col("m"), F.lit(float(exponent)))
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            want = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(want)
    mass = mass.withColumn("w", want)
    all_mass, all_want = mass.agg(F.sum("m"), F.sum("w")).first()
    return mass.select("__source", (F.col("w") / F.lit(all_want or 1.0) * F.lit(float(size) * (all_mass or 0.0)) / F.col("m")).alias("__rate"))


def mix_sources(docs: DataFrame, *, exponent: float = 0.5, weights: Mapping[str, float] | None = None, size: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each document as often as a Poisson count says, in a global random order.

    Returns the columns of ``docs`` and ``__rate``, ``__copy`` (from 1) and ``__order``; rows are sorted by ``__order``.

    Defined cases: a null source is a source of its own; a null text has the mass of one code point; rows with equal id
    get equal counts, as the count depends on seed and id only; rows with a null id share one draw; an empty table gives
    an empty table; other columns pass through.

    The rates have a row per source. They are written first, so that Spark knows their size: it broadcasts them below
    its threshold and otherwise joins by sort with skew handling, because one source may hold a third of the rows. The
    order is a range sort on a hash, which no source can skew.
    """
    rates = written(source_rates(docs, exponent=exponent, weights=weights, size=size, source_col=source_col, text_col=text_col), "rates")
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    n = poisson_count(F.col("__rate"), seed, F.col(id_col))
    repeated = joined.withColumn("__n", n).where(F.col("__n") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col("__copy").cast("string")))
    # written first: a range sort reads its input twice, once for a sample
    drawn = written(repeated.withColumn("__order", order).select(*docs.columns, "__rate", "__copy", "__order"), "drawn")
    return drawn.orderBy("__order")
