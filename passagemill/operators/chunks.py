"""Chunks: runs of paragraphs between split positions, and their metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions.arrays import before
from ..functions.text import approx_tokens, let
from ..schema import CHUNKS


def form_chunks(paragraphs: Column, positions: Column) -> Column:
    """Paragraphs cut before each position; position 0 and positions beyond the end cut nothing.

    A chunk's content is its texts with a blank line between; its sources are the paragraphs'
    source indexes, repeats kept; its section is that of its first paragraph.
    """

    def cut(ps: Column) -> Column:
        n = F.size(ps)
        starts = F.concat(F.array(F.lit(0)), F.filter(positions, lambda x: (x > 0) & (x < n)))

        def chunk(starts: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                mine = F.slice(ps, s + 1, F.coalesce(F.get(starts, i + 1), n) - s)
                return F.struct(
                    i.alias("chunk_ord"),
                    F.array_join(F.transform(mine, lambda p: p["text"]), "\n\n").alias("content"),
                    F.transform(mine, lambda p: F.coalesce(p["source_idx"], p["idx"])).alias("source_paragraphs"),
                    F.coalesce(ps[s]["section"], F.lit("")).alias("parent_section"),
                    F.lit(None).alias("metadata"),
                )

            return F.transform(starts, one)

        return F.when(n > 0, let(starts, chunk)).otherwise(F.array())

    return let(paragraphs, cut).cast(CHUNKS)


def _metadata(chunk: Column, answer: Column, tokens) -> Column:
    """Metadata from a model's answer, or without one from the text alone."""
    content = chunk["content"]

    def given(a: Column) -> Column:
        asked, keys = K.normalise_questions(a["questions"]), K.normalise_keywords(a["keywords"])
        return let(keys, lambda ks: F.struct(
            F.coalesce(a["title"], F.lit("Untitled")).alias("title"), F.coalesce(a["summary"], F.lit("")).alias("summary"),
            K.intent(F.coalesce(a["intent"], F.lit("unknown"))).alias("intent"),
            K.cover_keywords(asked, ks).alias("questions"), ks.alias("keywords"),
        ))

    fallback = let(K.simple_keywords(content), lambda ks: F.struct(
        K.fallback_title(content).alias("title"), F.lit(K.NO_SUMMARY).alias("summary"), F.lit("unknown").alias("intent"),
        K.fallback_questions(ks).alias("questions"), ks.alias("keywords"),
    ))
    made = F.when(answer["ok"], given(answer)).otherwise(fallback) if answer is not None else fallback
    return let(made, lambda m: F.struct(
        F.lit("").alias("chunk_id"), m["title"].alias("title"), m["summary"].alias("summary"), m["intent"].alias("intent"), m["questions"].alias("questions"),
        m["keywords"].alias("keywords"), chunk["parent_section"].alias("parent_section"), tokens(content).alias("token_count"),
    ))


def enrich(chunks: Column, answers: Column | None = None, fallback: bool = True, tokens=approx_tokens) -> Column:
    """Chunks with metadata, from one answer each in order, or by fallback.

    Ids run over the chunks that get metadata. Without ``fallback`` a chunk whose answer is not
    ok keeps null metadata.
    """
    pairs = chunks if answers is None else F.arrays_zip(chunks.alias("c"), answers.alias("a"))

    def one(x: Column) -> Column:
        c, a = (x, None) if answers is None else (x["c"], x["a"])
        metadata = _metadata(c, a, tokens)
        if a is not None and not fallback:
            metadata = F.when(a["ok"], metadata)
        return F.struct(c["chunk_ord"].alias("chunk_ord"), c["content"].alias("content"), c["source_paragraphs"].alias("source_paragraphs"), c["parent_section"].alias("parent_section"), metadata.alias("metadata"))

    return number_chunks(F.transform(pairs, one)).cast(CHUNKS)


def number_chunks(chunks: Column) -> Column:
    """Chunk ids ``chunk_001`` and on, over the chunks that have metadata."""

    def of(cs: Column) -> Column:
        named = lambda c, n: c.withField("metadata", c["metadata"].withField("chunk_id", F.format_string("chunk_%03d", n)))
        has = lambda c: c["metadata"].isNotNull()
        ranks = before(F.transform(cs, lambda c: has(c).cast("long")))
        some = F.zip_with(cs, ranks, lambda c, n: F.when(has(c), named(c, (n + 1).cast("int"))).otherwise(c))
        return F.when(F.forall(cs, has), F.transform(cs, lambda c, i: named(c, i + 1))).otherwise(some)

    return let(chunks, of)
