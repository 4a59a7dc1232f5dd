"""Boundaries between neighbouring paragraphs: proposals, decisions and where chunks are cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keywords import verdict
from ..functions.text import head_preview, let, tail_preview
from ..schema import DECISIONS, PROPOSALS
from .paragraphs import splittable

#: What a decision says where the model's reply is missing.
FAILED_REASON = "LLM validation failed, defaulting to KEEP"
FAILED_CONFIDENCE = 0.5


def _lexical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def of(texts: list[str]) -> list[float]:
        counts = [Counter(t.lower().split()) for t in texts]
        norms = [sum(n * n for n in c.values()) for c in counts]
        out = []
        for a, b, x, y in zip(counts, counts[1:], norms, norms[1:]):
            if len(a) > len(b):
                a, b = b, a
            out.append(sum(n * b[w] for w, n in a.items() if w in b) / (x * y) ** 0.5 if x and y else 0.0)
        return out

    for texts in batches:
        yield texts.map(lambda ts: [] if ts is None else of(list(ts)))


_lexical.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}


def adjacent_lexical(texts: Column) -> Column:
    """Cosine of the word counts of each text of an array with the next; 0 where either has no words.

    The counts are whole numbers, so one square root and one division are all that rounds. Marked
    nondeterministic, as all Python functions here: that keeps Catalyst from moving the call into
    the body of a higher-order function, where it can't run.
    """
    return F.pandas_udf(_lexical, "array<double>").asNondeterministic()(texts)


def splittable_texts(paragraphs: Column) -> Column:
    return F.transform(F.filter(paragraphs, splittable), lambda p: p["text"])


def propose(paragraphs: Column, similarities: Column, threshold: float) -> Column:
    """A proposal at each splittable paragraph that is less like the one before than ``threshold``.

    ``similarities`` are those of neighbouring splittable paragraphs: code, lists and quotes are
    leapt over, and so stay with the chunk before.
    """

    def of(ps: Column) -> Column:
        made = F.transform(
            similarities,
            lambda s, i: F.struct(ps[i + 1]["idx"].alias("position"), s.alias("similarity"), ps[i]["text"].alias("text_before"), ps[i + 1]["text"].alias("text_after")),
        )
        return F.filter(made, lambda b: b["similarity"] < threshold)

    return let(F.filter(paragraphs, splittable), of).cast(PROPOSALS)


def previews(proposals: Column, size: int = 500) -> Column:
    """The two texts of each proposal, as much of them as a model is shown."""
    return F.transform(proposals, lambda p: F.struct(tail_preview(p["text_before"], size).alias("before"), head_preview(p["text_after"], size).alias("after")))


def decide(proposals: Column, answers: Column) -> Column:
    """Decisions from (ok, verdict, reason, confidence) answers, one for each proposal, in order.

    A reply that is missing or no JSON object keeps the boundary, with half the confidence. An
    ADJUST never carries a new position, so it splits where it was proposed.
    """

    def one(p: Column, a: Column) -> Column:
        return F.struct(
            p["position"].alias("position"), p["similarity"].alias("similarity"),
            F.when(a["ok"], verdict(F.coalesce(a["verdict"], F.lit("KEEP")))).otherwise(F.lit("KEEP")).alias("verdict"),
            F.when(a["ok"], F.coalesce(a["reason"], F.lit(""))).otherwise(F.lit(FAILED_REASON)).alias("reason"),
            F.lit(None).cast("int").alias("adjusted_position"),
            F.when(a["ok"], F.coalesce(a["confidence"], F.lit(1.0))).otherwise(F.lit(FAILED_CONFIDENCE)).alias("confidence"),
        )

    return F.zip_with(proposals, answers, one).cast(DECISIONS)


def keep_all(proposals: Column) -> Column:
    """Decisions that keep every proposal, for runs without a model."""
    answer = F.transform(proposals, lambda p: F.struct(F.lit(True).alias("ok"), F.lit("KEEP").alias("verdict"), F.lit("").alias("reason"), F.lit(1.0).alias("confidence")))
    return decide(proposals, answer)


def final_position(d: Column) -> Column:
    """Where a decision splits: nowhere for MERGE, else the adjusted or the proposed position."""
    return F.when(d["verdict"] == "MERGE", F.lit(None).cast("int")).when(d["verdict"] == "ADJUST", F.coalesce(d["adjusted_position"], d["position"])).otherwise(d["position"])


def split_positions(decisions: Column) -> Column:
    """All final positions, in order, each once."""
    return F.array_distinct(F.sort_array(F.filter(F.transform(decisions, final_position), lambda x: x.isNotNull())))
