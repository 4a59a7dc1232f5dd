"""Plain-text documents, from files, tables or memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, let, text_paragraphs
from ..operators.paragraphs import plain
from ..schema import PARSED


def decode(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def outline(texts: Column) -> Column:
    """Paragraphs and the implicit section of an array of paragraph texts; no section without paragraphs."""
    implicit = F.array(F.struct(F.lit(0).alias("section_ord"), F.lit("").alias("title"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent_ord")))
    of = lambda t: F.struct(plain(t).alias("paragraphs"), F.when(F.size(t) > 0, implicit).otherwise(F.array()).alias("sections"))
    return let(texts, of).cast(PARSED)


def parse(raw: Column) -> Column:
    return outline(text_paragraphs(raw))


def collapse_turn(said: Column) -> Column:
    """A turn of a conversation as one paragraph."""
    return collapse(F.coalesce(said, F.lit("")))
