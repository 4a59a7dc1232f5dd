"""PDF documents: spans from PyMuPDF where it is installed, everything after as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.arrays import gather, runs
from ..functions.text import let, strip, words
from ..schema import PARAGRAPH, PARSED, SECTION

SPANS = "array<struct<page:int,block:int,line:int,span:int,text:string,size:double,flags:int>>"
BLOCKS = "array<struct<text:string,avg_size:double,max_size:double,bold:boolean>>"
# Point sizes from which text is a heading, words of one at most, size where none is known, the bold bit.
SIZE_1, SIZE_2, MAX_WORDS, DEFAULT_SIZE, BOLD = 14.0, 12.0, 10, 12.0, 16


def _opened(content: bytes):
    """A PDF as PyMuPDF opens it: pages with ``get_text("dict")`` and ``get_text()``."""
    try:
        import fitz
    except ImportError as e:
        raise ParseError("reading PDF files needs PyMuPDF") from e
    return fitz.open(stream=content, filetype="pdf")


def read_spans(content: bytes, opened: Callable = _opened) -> list[dict]:
    """All text spans of a PDF, in page order. ``opened`` makes a document of a file's bytes."""
    out = []
    with opened(content) as pdf:
        for p, page in enumerate(pdf):
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                if block.get("type") != 0:
                    continue
                for n, line in enumerate(block["lines"]):
                    for s, span in enumerate(line["spans"]):
                        out.append({"page": p, "block": b, "line": n, "span": s, "text": span["text"], "size": float(span.get("size", DEFAULT_SIZE)), "flags": int(span.get("flags", 0))})
    return out


def read_text(content: bytes, opened: Callable = _opened) -> str:
    """The pages' texts as the reader gives them, joined by line ends."""
    with opened(content) as pdf:
        return "\n".join(page.get_text() for page in pdf)


def spans(content: Column, opened: Callable = _opened) -> Column:
    """Spans of a column of PDF bytes; null where a file can't be read."""

    def one(data: bytes | None) -> list[dict] | None:
        try:
            return read_spans(bytes(data), opened) if data is not None else None
        except Exception:
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPANS).asNondeterministic()(content)


def text_blocks(items: Column) -> Column:
    """Blocks of spans in order: their text, average and largest size, and whether any of it is bold."""

    def line(ss: Column) -> Column:
        return F.array_join(F.transform(ss, lambda s: s["text"]), " ")

    def block(mine: Column) -> Column:
        sizes = F.transform(mine, lambda s: F.coalesce(s["size"], F.lit(DEFAULT_SIZE)))
        return F.struct(
            F.array_join(F.transform(runs(mine, lambda s: s["line"]), line), " ").alias("text"),
            (F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(mine)).alias("avg_size"), F.array_max(sizes).alias("max_size"),
            F.exists(mine, lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(BOLD) != 0).alias("bold"),
        )

    def of(ss: Column) -> Column:
        blocks = runs(ss, lambda s: F.struct(s["page"].alias("page"), s["block"].alias("block")))
        return F.filter(F.transform(blocks, block), lambda b: strip(b["text"]) != "")

    ordered = F.array_sort(F.transform(items, lambda s: F.struct(*[s[c].alias(c) for c in ("page", "block", "line", "span", "text", "size", "flags")])))
    return let(ordered, of).cast(BLOCKS)


def heading_level(block: Column) -> Column:
    """1 to 3 for a heading, else null; the first rule that fits decides."""
    text = strip(block["text"])
    brief = F.size(words(text)) <= MAX_WORDS
    return (
        F.when((block["avg_size"] >= SIZE_1) & brief, F.lit(1))
        .when((block["avg_size"] >= SIZE_2) & block["bold"] & brief, F.lit(2))
        .when(block["bold"] & brief & ~F.right(text, F.lit(1)).isin(".", ",", ";", ":"), F.lit(3))
    )


def outline(items: Column) -> Column:
    """Paragraphs and sections from blocks; sections nest one deep, under the last of level 1 or the last root."""

    def step(acc: Column, b: Column) -> tuple[Column, Column]:
        level, text = b["level"], b["text"]
        head = level.isNotNull()
        # Text before any heading opens an implicit section, which is a root as well.
        first = ~head & (acc["n"] == 0)
        root = (level == 1) | acc["root"].isNull() | (level <= acc["root_level"])
        title = F.when(head, text).otherwise(acc["title"])
        after = F.struct(
            title.alias("title"), F.when(head & root, acc["n"]).when(first, F.lit(None).cast("int")).otherwise(acc["root"]).alias("root"),
            F.when(head & root, level).otherwise(acc["root_level"]).alias("root_level"), F.when(head | first, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        )
        section = F.struct(
            acc["n"].alias("section_ord"), F.when(head, text).otherwise(F.lit("")).alias("title"), F.coalesce(level, F.lit(0)).alias("level"), F.when(head & ~root, acc["root"]).alias("parent_ord")
        )
        para = F.struct(
            F.lit(0).alias("idx"), text.alias("text"), F.lit("paragraph").alias("element_type"), F.lit(False).alias("is_atomic"),
            F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("source_idx"), title.alias("section"),
        )
        return after, F.array(F.struct(F.when(head | first, section).alias("section"), F.when(~head, para).alias("para")))

    def split(found: Column) -> Column:
        kept = lambda name: F.filter(F.transform(found, lambda x: x[name]), lambda x: x.isNotNull())
        return F.struct(F.transform(kept("para"), lambda p, i: p.withField("idx", i)).alias("paragraphs"), kept("section").alias("sections"))

    none = F.lit(None).cast("int")
    state = F.struct(F.lit("").alias("title"), none.alias("root"), none.alias("root_level"), F.lit(0).alias("n"))
    known = F.transform(items, lambda b: F.struct(heading_level(b).alias("level"), strip(b["text"]).alias("text")))
    return let(gather(known, state, step, f"struct<section:{SECTION},para:{PARAGRAPH}>"), split).cast(PARSED)


def raw_text(items: Column) -> Column:
    """The texts of spans, pages joined by line ends: where only spans are at hand, else :func:`page_text`."""
    ordered = F.array_sort(F.transform(items, lambda s: F.struct(*[s[c].alias(c) for c in ("page", "block", "line", "span", "text")])))
    return F.array_join(F.transform(runs(ordered, lambda s: s["page"]), lambda ss: F.array_join(F.transform(ss, lambda s: s["text"]), " ")), "\n")


def page_text(content: Column, opened: Callable = _opened) -> Column:
    """The texts of a column of PDF bytes, without structure; null where a file can't be read."""

    def one(data: bytes | None) -> str | None:
        try:
            return read_text(bytes(data), opened) if data is not None else None
        except Exception:
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string").asNondeterministic()(content)


def parse(content: Column, opened: Callable = _opened) -> Column:
    return let(spans(content, opened), lambda s: F.when(s.isNotNull(), outline(text_blocks(s))))
