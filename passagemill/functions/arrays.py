"""Sequential work over long arrays whose cost stays linear.

A fold that appends to its result copies it at every step. Here the result is gathered in chunks,
and only the list of chunks is appended to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Items in a chunk: a million of them copy a few hundred million references in all.
CHUNK = 256


def gather(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(state, item) -> (next state, array of kind)`` puts out for each item, in one array."""

    def through(chunk: Column, start: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            after, out = step(acc["s"], item)
            return F.struct(after.alias("s"), F.concat(acc["o"], out).alias("o"))

        return F.aggregate(chunk, F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("o")), one)

    def chunks(all_items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / CHUNK).cast("int"))
        return F.transform(starts, lambda c: F.slice(all_items, c * CHUNK + 1, F.lit(CHUNK)))

    def over(acc: Column, chunk: Column) -> Column:
        return let(through(chunk, acc["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    def run(all_items: Column) -> Column:
        zero = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        found = F.aggregate(chunks(all_items), zero, over, lambda acc: F.flatten(acc["o"]))
        return F.when(F.size(all_items) > 0, found).otherwise(F.array().cast(f"array<{kind}>"))

    return let(items, run)


def before(sizes: Column) -> Column:
    """The sum of all earlier elements, for each element of an array of whole numbers."""
    return gather(sizes, F.lit(0).cast("long"), lambda total, n: (total + n, F.array(total)), "bigint")


def runs(items: Column, key: Callable[[Column], Column]) -> Column:
    """The array cut where ``key`` changes between neighbours: an array of arrays."""

    def cut(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | ~key(xs[i]).eqNullSafe(key(F.get(xs, i - 1))))
        ends = lambda at: F.transform(at, lambda s, k: F.slice(xs, s + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - s))
        return F.when(F.size(xs) > 0, let(starts, ends)).otherwise(F.array())

    return let(items, cut)
