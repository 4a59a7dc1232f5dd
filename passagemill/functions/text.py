"""Text expressions: white space, sentences, tokens and previews, all on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it, as a regular-expression class.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: Tokens in a word, roughly.
TOKENS_PER_WORD = 1.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    A barrier: collapsing projections would otherwise evaluate a costly array again for each use.
    """
    return F.transform(F.array(value), body)[0]


def barrier(value: Column) -> Column:
    """``value``, computed where it is defined and nowhere else.

    A nondeterministic condition that always holds keeps Catalyst from merging the projection into
    others. What goes into a Python function is passed through one, as functions whose arguments
    hold higher-order functions are not always found by the rule that runs them.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def collapse(text: Column) -> Column:
    """All runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def words(text: Column) -> Column:
    """The words between white space; none for an empty text."""
    return F.array_remove(F.split(collapse(F.coalesce(text, F.lit(""))), " ", -1), "")


def sentences(text: Column) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``; stripped, none empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){WS}+", -1)
    return F.array_remove(F.transform(pieces, strip), "")


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def text_paragraphs(raw: Column) -> Column:
    """Paragraphs of a plain text: split on exactly two line ends, collapsed, none empty."""
    unix = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n?", "\n")
    return F.array_remove(F.transform(F.split(unix, "\n\n", -1), collapse), "")


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return (F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int")


def truncate_words(text: Column, tokens: int) -> Column:
    """As many first words as about ``tokens`` tokens hold."""
    return F.array_join(F.slice(words(text), 1, int(tokens / TOKENS_PER_WORD)), " ")


def tail_preview(text: Column, size: int = 500) -> Column:
    """The last ``size`` characters, after ``...`` if that is not all."""
    return F.when(F.length(text) > size, F.concat(F.lit("..."), F.right(text, F.lit(size)))).otherwise(text)


def head_preview(text: Column, size: int = 500) -> Column:
    """The first ``size`` characters, before ``...`` if that is not all."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def context_text(before: Column, after: Column) -> Column:
    """Both sides of a boundary under their headings."""
    return F.concat(F.lit("END OF CHUNK:\n"), before, F.lit("\n\nSTART OF NEW CHUNK:\n"), after)
