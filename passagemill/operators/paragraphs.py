"""Paragraph arrays: building, predicates, atomizing, splitting and sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import gather, runs
from ..functions.text import approx_tokens, let, sentences, strip
from ..schema import PARAGRAPHS


def plain(texts: Column, section: Column | None = None) -> Column:
    """Paragraphs of plain texts, in order, under one implicit section."""
    return F.transform(
        texts,
        lambda t, i: F.struct(
            i.alias("idx"), t.alias("text"), F.lit("paragraph").alias("element_type"), F.lit(False).alias("is_atomic"),
            F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("source_idx"), (F.lit("") if section is None else section).alias("section"),
        ),
    ).cast(PARAGRAPHS)


def splittable(p: Column) -> Column:
    return ~p["is_atomic"] & (p["element_type"] == "paragraph")


def atomic_count(paragraphs: Column) -> Column:
    return F.size(F.filter(paragraphs, lambda p: p["is_atomic"]))


def _with(p: Column, idx: Column, text: Column, source: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), text.alias("text"), p["element_type"].alias("element_type"), p["is_atomic"].alias("is_atomic"), p["language"].alias("language"), source.alias("source_idx"), p["section"].alias("section"))


def renumber(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda p, i: _with(p, i, p["text"], p["source_idx"]))


def groups_of(ss: Column, size: Column) -> Column:
    """Sentences joined in groups of ``size``; a short tail goes to the last group."""

    def cut(k: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), k - 1),
            lambda i: F.array_join(F.slice(ss, i * size + 1, F.when(i < k - 1, size).otherwise(F.size(ss))), " "),
        )

    return let(F.floor(F.size(ss) / size).cast("int"), cut)


def atomize(paragraphs: Column, group_size: Column, min_sentences: Column) -> Column:
    """Splittable paragraphs of enough sentences, cut into groups of sentences.

    Other paragraphs stay; blank splittable ones go. Indexes are dense again, and source_idx
    is the first known index. A group size of 0 leaves everything as it is.
    """

    def parts(p: Column) -> Column:
        whole = F.array(strip(p["text"]))

        def cut(ss: Column) -> Column:
            few = F.size(ss) < F.greatest(min_sentences, group_size + 1)
            return F.when(few, whole).otherwise(groups_of(ss, group_size))

        texts = F.when(~splittable(p), F.array(p["text"])).when(strip(p["text"]) == "", F.array().cast("array<string>")).otherwise(let(sentences(p["text"]), cut))
        return F.transform(texts, lambda t: _with(p, F.lit(0), t, F.coalesce(p["source_idx"], p["idx"])))

    return F.when(group_size <= 0, paragraphs).otherwise(renumber(F.flatten(F.transform(paragraphs, parts))))


def sentence_counts(paragraphs: Column) -> Column:
    """Sentences of each paragraph, -1 for one that is not splittable."""
    return F.transform(paragraphs, lambda p: F.when(splittable(p), F.size(sentences(p["text"]))).otherwise(F.lit(-1)))


def estimate_atoms(counts: Column, group_size: Column, min_sentences: Column) -> Column:
    """Atoms that :func:`atomize` would make of paragraphs with these sentence counts."""
    made = lambda c: F.when(c < F.greatest(min_sentences, group_size + 1), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(c / group_size).cast("int")))
    return F.aggregate(counts, F.lit(0), lambda a, c: a + made(c))


def split_by_tokens(paragraphs: Column, max_tokens: int) -> Column:
    """Splittable paragraphs over ``max_tokens``, packed greedily by whole sentences.

    A single sentence over the limit stays whole. Indexes are dense again; source_idx is dropped.
    """

    def pack(ss: Column) -> Column:
        def step(acc: Column, n: Column) -> tuple[Column, Column]:
            over = (acc["n"] > 0) & (acc["n"] + n > max_tokens)
            pack_no = F.when(over, acc["pack"] + 1).otherwise(acc["pack"])
            return F.struct(pack_no.alias("pack"), (F.when(over, n).otherwise(acc["n"] + n)).alias("n")), F.array(pack_no)

        packs = gather(F.transform(ss, approx_tokens), F.struct(F.lit(0).alias("pack"), F.lit(0).alias("n")), step, "int")
        return F.transform(runs(F.arrays_zip(ss.alias("s"), packs.alias("k")), lambda x: x["k"]), lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), " "))

    def parts(p: Column) -> Column:
        fits = ~splittable(p) | (approx_tokens(p["text"]) <= max_tokens)
        texts = F.when(fits, F.array(p["text"])).otherwise(let(sentences(p["text"]), lambda ss: F.when(F.size(ss) <= 1, F.array(p["text"])).otherwise(pack(ss))))
        return F.transform(texts, lambda t: _with(p, F.lit(0), t, F.lit(None).cast("int")))

    return renumber(F.flatten(F.transform(paragraphs, parts)))


def sample(paragraphs: Column, most: int) -> Column:
    """At most ``most`` paragraphs: a third from the head, a third from the tail, the rest centred.

    With ``most`` 1 or 2 a third is nothing, and nothing of the tail means all of it: every
    paragraph comes back.
    """
    third = most // 3
    if third == 0:
        return paragraphs

    def pick(n: Column) -> Column:
        rest = most - 2 * third
        start = F.greatest(F.floor(n / 2).cast("int") - rest // 2, F.lit(third))
        end = F.least(start + rest, n - third)
        middle = F.slice(paragraphs, start + 1, F.greatest(end - start, F.lit(0)))
        return F.concat(F.slice(paragraphs, 1, third), middle, F.slice(paragraphs, -third, third))

    return F.when(F.size(paragraphs) <= most, paragraphs).otherwise(let(F.size(paragraphs), pick))
