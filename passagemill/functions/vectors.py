"""Similarity of neighbouring vectors and its statistics, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""

    def divided(norms: Column) -> Column:
        return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))

    return let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), divided)


def float_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of 32-bit floats, whose squared lengths can be multiplied without overflow.

    Of whole numbers, such as word counts, one square root and one division are all that rounds: a
    cosine that is a threshold exactly is not below it.
    """

    def divided(square: Column) -> Column:
        return F.when(square > 0, dot(a, b) / F.sqrt(square)).otherwise(F.lit(0.0))

    return let(dot(a, a) * dot(b, b), divided)


def adjacent_cosines(vectors: Column, of: Callable[[Column, Column], Column] = cosine) -> Column:
    """Cosine of each vector with the next; none for fewer than two vectors."""

    def pairs(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda i: of(v[i], v[i + 1]))

    return let(vectors, lambda v: F.when(F.size(v) > 1, pairs(v)).otherwise(F.array().cast("array<double>")))


def candidates(similarities: Column, threshold: float) -> Column:
    """Positions (of the later element) and similarities that lie strictly below the threshold."""
    numbered = F.transform(similarities, lambda s, i: F.struct((i + 1).alias("position"), s.alias("similarity")))
    return F.filter(numbered, lambda p: p["similarity"] < threshold)


def percentile(values: Column, percent: float) -> Column:
    """Linearly interpolated percentile of an array; null if it is empty."""

    def of(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(percent / 100.0)
        low = F.floor(at).cast("int")
        high = F.ceil(at).cast("int")
        return v[low] + (v[high] - v[low]) * (at - low)

    return let(F.sort_array(values), lambda v: F.when(F.size(v) > 0, of(v)))


def adaptive_threshold(similarities: Column, percent: float = 25.0) -> Column:
    """A threshold at a percentile of the similarities; 0.5 without any."""
    return F.coalesce(percentile(similarities, percent), F.lit(0.5))


def statistics(similarities: Column) -> Column:
    """mean, (population) std, min, max, count and median; zeros and a null median without any."""

    def of(v: Column) -> Column:
        n = F.size(v)
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

        def full(mean: Column) -> Column:
            spread = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
            return F.struct(
                mean.alias("mean"), F.sqrt(spread / n).alias("std"), F.array_min(v).alias("min"), F.array_max(v).alias("max"),
                n.cast("long").alias("count"), percentile(v, 50.0).alias("median"),
            )

        zero = F.lit(0.0)
        none = F.struct(zero.alias("mean"), zero.alias("std"), zero.alias("min"), zero.alias("max"), F.lit(0).cast("long").alias("count"), F.lit(None).cast("double").alias("median"))
        return F.when(n > 0, let(total / n, full)).otherwise(none)

    return let(F.coalesce(similarities, F.array().cast("array<double>")), of)
