"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of equal length. With target weight
``w`` a source's k-th block (from 0) is released at slot ``floor(k / w)`` and
due by slot ``ceil((k + 1) / w)``; at every slot the earliest deadline among the
released blocks goes first. Windows are exact: weights are whole numbers ``q``
of a hyperperiod of ``period`` slots, the common denominator of the targets, at
whose end every source is exactly at its share. So one hyperperiod's schedule,
repeated, keeps each source within one block of its target at every slot of a
run of any length, as long as the source lasts.

The hyperperiod's schedule is the only thing held on the driver: at most PERIOD
numbers, whatever the corpus. All that touches rows is DataFrame expressions.
The numbering inside a source runs over hashed pieces of bounded size with
offsets per piece, so a source that holds most of the rows is many tasks.
"""

from __future__ import annotations

from array import array
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import hold, table

#: Characters in a block.
BLOCK = 1 << 16
#: Slots of one hyperperiod that are scheduled at most. Targets whose common denominator is larger are multiples of
#: 1 / FINE in a run of no more slots than that (its hyperperiod then never ends), and of 1 / PERIOD in a longer one.
PERIOD, FINE = 1 << 20, 1 << 40
#: Blocks of a source that a row of the schedule holds.
RUN = 1 << 10
#: Rows that a piece of a source holds about, and pieces that are numbered together.
PIECE, SHELF = 1 << 10, 1 << 12
#: Default target: a source's share of all characters to this power.
TEMPERATURE = 0.5


def shares(weights: dict[str, Fraction], period: int = PERIOD) -> tuple[int, dict[str, int]]:
    """The hyperperiod and each source's slots in it; weight 0 has none.

    Exact where the weights' common denominator is at most ``period``. Else multiples of
    ``1 / period`` by largest remainder (ties by name); a smaller weight counts as that much.
    """
    total = sum(weights.values())
    if not total:
        return 0, dict.fromkeys(weights, 0)
    exact = {x: w / total for x, w in weights.items()}
    slots = lcm(*(w.denominator for w in exact.values()))
    if slots <= period:
        return slots, {x: int(w * slots) for x, w in exact.items()}
    q = {x: max(1, int(w * period)) if w else 0 for x, w in exact.items()}
    over = period - sum(q.values())
    for x in sorted((x for x in q if q[x]), key=lambda x: (q[x] - exact[x] * period, x))[: max(over, 0)]:
        q[x] += 1
    for x in sorted(q, key=lambda x: (-q[x], x)) if over < 0 else []:  # what the least weights were given comes out of the largest
        less = min(-over, q[x] - 1)
        q[x] -= max(less, 0)
        over += max(less, 0)
    # More sources than slots: a slot each.
    return sum(q.values()), q


def place(slots: int, q: dict[str, int], until: int) -> dict[str, array]:
    """The slots before ``until`` of each source's blocks: earliest deadline first, in exact numbers."""
    names = sorted(x for x in q if q[x])
    at = {x: array("q") for x in names}
    waiting = [(0, x) for x in names]  # by release
    ready: list[tuple[int, str]] = []  # by deadline, ties by name
    heapify(waiting)
    for t in range(min(slots, until)):
        while waiting and waiting[0][0] <= t:
            x = heappop(waiting)[1]
            heappush(ready, (-(-(len(at[x]) + 1) * slots // q[x]), x))
        x = heappop(ready)[1]  # never empty: at slot t more than t blocks are released
        at[x].append(t)
        heappush(waiting, (len(at[x]) * slots // q[x], x))
    return at


def _needed(blocks: dict[str, int], slots: int, q: dict[str, int]) -> int:
    """Slots of the hyperperiod in which a block falls."""
    return max((-(-min(blocks[x], n) * slots // n) for x, n in q.items() if n), default=0)


def schedule(spark: SparkSession, blocks: dict[str, int], weights: dict[str, Fraction], period: int = PERIOD) -> DataFrame:
    """``(src, run, q, slots, base, at)``: block ``b`` has the slot ``base + b div q * slots + at[b % q]``.

    A row holds RUN of the ``q`` values of ``at``. Sources of weight 0 come after all others'
    last blocks, one after the other.
    """
    slots, q = shares(weights, period)
    if slots == period:
        fine, finer = shares(weights, FINE)
        if _needed(blocks, fine, finer) <= period:
            slots, q = fine, finer
    needed = _needed(blocks, slots, q)
    at = place(slots, q, needed)
    rows = [(x, k // RUN, q[x], slots, 0, own[k : k + RUN].tolist()) for x, own in at.items() for k in range(0, len(own), RUN)]
    base = 1 + max(((blocks[x] - 1) // q[x] * slots + own[(blocks[x] - 1) % q[x]] for x, own in at.items()), default=-1)
    for x in sorted(x for x in q if not q[x]):
        rows.append((x, 0, 1, 1, base, [0]))
        base += blocks[x]
    return spark.createDataFrame(rows, "src string, run long, q long, slots long, base long, at array<long>")


def _weights(sources: DataFrame, targets: DataFrame | None) -> tuple[dict[str, int], dict[str, Fraction]]:
    """Characters and weight of each source; one row per source, which is metadata."""
    chars = {r["src"]: r["chars"] for r in sources.collect()}
    if targets is None:
        return chars, {x: Fraction(max(n, 1) ** TEMPERATURE) for x, n in chars.items()}
    given = dict.fromkeys(chars, Fraction(0))
    listed = targets.select(F.coalesce("source", F.lit("")).alias("src"), "weight").join(sources.select("src"), "src", "left_semi")
    for r in listed.where("weight > 0").collect():
        given[r["src"]] += Fraction(repr(r["weight"])) if isinstance(r["weight"], float) else Fraction(r["weight"])
    return chars, given


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """A training order of all rows of ``docs(doc_id, source, text)``.

    Returns all columns of ``docs`` with n_chars (of the text), block (number within the source), slot
    (position of the block among all blocks; equal for the documents of one block) and place (order
    within the source), which replace columns so called: reading by (slot, place) gives the mix.
    ``place`` is the characters of the source before the document, plus ties by doc_id.

    Every row is kept, once. When a source has run out the others keep their windows, and slots
    that nobody claims stay empty. A null source counts as the source "" and is returned as
    null; a null text has no characters; repeated rows are placed one by one. A text longer than
    a block takes up as many blocks as it fills. Targets (source, weight; several of one source add
    up) default to the share of characters to the power TEMPERATURE. A source that is unlisted or
    has weight 0 has no share: its rows come after all others. If no source has a weight, they
    come one after the other. An empty table gives an empty one.
    """
    return _mixed(docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")), targets, block, period)


def _mixed(docs: DataFrame, targets: DataFrame | None, block: int, period: int) -> DataFrame:
    docs = docs.drop("block", "slot", "place")
    pieces = max(1, -(-docs.count() // PIECE))
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(pieces))
    # The row goes along whole, so that its columns' names clash with none of these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("source", F.lit("")).alias("src"), piece.alias("piece"), F.col("n_chars").alias("n"))
    sizes = docs.select(F.coalesce("source", F.lit("")).alias("src"), piece.alias("piece"), F.col("n_chars").alias("n")).withColumn("shelf", F.expr(f"piece div {SHELF}"))
    sizes = hold(sizes.groupBy("src", "shelf", "piece").agg(F.sum("n").alias("chars")))
    earlier = lambda by, order: F.coalesce(F.sum("chars").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shelves = sizes.groupBy("src", "shelf").agg(F.sum("chars").alias("chars")).select("src", "shelf", earlier(["src"], "shelf").alias("below"))
    offsets = sizes.withColumn("inner", earlier(["src", "shelf"], "piece")).join(shelves, ["src", "shelf"]).select("src", "piece", (F.col("below") + F.col("inner")).alias("offset"))
    chars, weights = _weights(sizes.groupBy("src").agg(F.sum("chars").alias("chars")), targets)
    plan = schedule(docs.sparkSession, {x: n // int(block) + 1 for x, n in chars.items()}, weights, period)

    inside = Window.partitionBy("src", "piece").orderBy(F.xxhash64("row.doc_id"), "row.doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["src", "piece"])
    placed = placed.select("row", "src", (F.col("offset") + F.col("inner")).alias("place"))
    # At most PERIOD numbers in all, and a row per source: the schedule's size is bounded and known here.
    placed = placed.withColumn("block", F.expr(f"place div {int(block)}")).join(F.broadcast(plan.select("src", "q", "slots", "base").distinct()), "src")
    placed = placed.withColumn("turn", F.col("block") % F.col("q")).withColumn("run", F.expr(f"turn div {RUN}"))
    placed = placed.join(F.broadcast(plan.select("src", "run", "at")), ["src", "run"])
    slot = F.expr(f"base + block div q * slots + element_at(at, cast(turn % {RUN} AS int) + 1)")
    return placed.select(*[F.col("row").getField(x).alias(x) for x in docs.columns], "block", slot.alias("slot"), "place")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The order alone: texts are measured in the scan and stay out of the exchange.
    narrow = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return _mixed(narrow, None, BLOCK, PERIOD)


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
