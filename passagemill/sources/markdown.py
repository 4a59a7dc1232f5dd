"""Markdown documents: a block tokenizer in Python, sections and paragraphs as expressions.

The tokenizer covers block structure: headings, fenced and indented code, quotes, lists,
rules, HTML blocks and, on request, pipe tables. Inline markup stays as it is written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import gather
from ..functions.text import let
from ..schema import PARAGRAPH, PARAGRAPHS, PARSED, SECTION

BLOCKS = "array<struct<kind:string,level:int,text:string,language:string>>"

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^\n]*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
QUOTE = re.compile(r" {0,3}>[ ]?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)|$)")
# How the kinds of HTML blocks begin, each with what ends it; None is a blank line.
_RAW = "script|pre|style|textarea"
_PLAIN = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|"
    "iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_ATTRIBUTE = r"""[ \t]+[A-Za-z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
HTML = [
    (re.compile(rf" {{0,3}}<(?:{_RAW})(?:[ \t>]|$)", re.I), re.compile(rf"</(?:{_RAW})>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf" {{0,3}}</?(?:{_PLAIN})(?:[ \t]|/?>|$)", re.I), None),
]
#: A whole tag alone on its line; unlike the others it can't end a paragraph.
LONE_TAG = re.compile(rf" {{0,3}}(?:<(?!(?:{_RAW})\b)[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*[ \t]*/?>|</(?!(?:{_RAW})\b)[A-Za-z][A-Za-z0-9-]*[ \t]*>)[ \t]*$", re.I)
#: A link reference definition, which is no text of the document.
DEFINITION = re.compile(
    r""" {0,3}\[(?!\s*\])(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*\n?[ \t]*(?:<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)"""
    r"""(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))[ \t]*(?:\n|\Z)|[ \t]*(?:\n|\Z))""",
    re.S,
)
DASHES = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Block:
    kind: str
    text: str = ""
    level: int = 0
    language: str | None = None
    #: Blocks of a quote or of the items of a list.
    inner: list[Block] = field(default_factory=list)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _columns(line: str) -> str:
    """A line whose leading tabs are spaces; others stay."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return lead.expandtabs(4) + line[len(lead) :] if "\t" in lead else line


def _dedent(line: str, width: int) -> str:
    """A line without so many columns of white space; what is left of a tab is spaces."""
    at = 0
    for k, c in enumerate(line):
        if at >= width or c not in " \t":
            return " " * (at - width) + line[k:]
        at += 1 if c == " " else 4 - at % 4
    return " " * (at - width)


def _html(lines: list[str], i: int) -> int | None:
    """Where the HTML block that starts at a line ends; None if there is none."""
    for start, end in HTML:
        if start.match(lines[i]):
            break
    else:
        if not LONE_TAG.match(lines[i]):
            return None
        end = None
    while i < len(lines) and (end or lines[i].strip()):
        i += 1
        if end and end.search(lines[i - 1]):
            break
    return i


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    if ATX.match(line) or RULE.match(line) or QUOTE.match(line) or any(start.match(line) for start, _ in HTML):
        return True
    fence = FENCE.match(line)
    if fence and not (fence[2][0] == "`" and "`" in fence[3]):
        return True
    item = ITEM.match(line)
    return bool(item and line[item.end() :].strip() and (not item[2][0].isdigit() or item[2][:-1] == "1"))


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def tokenize(text: str, tables: bool = False) -> list[Block]:
    """The blocks of a text, in order."""
    raw = re.sub(r"\r\n?", "\n", text).split("\n")
    lines = [_columns(x) for x in raw]
    out: list[Block] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if _indent(line) >= 4:
            j = i
            while j < len(lines) and (_indent(lines[j]) >= 4 or not lines[j].strip()):
                j += 1
            out.append(Block("code", "\n".join(_dedent(x, 4) for x in raw[i:j]).rstrip()))
            i = j
            continue
        heading, fence = ATX.match(line), FENCE.match(line)
        if heading:
            out.append(Block("heading", (heading[2] or "").strip().strip("#").strip() if set(heading[2] or "") <= {"#"} else heading[2].strip(), len(heading[1])))
            i += 1
        elif fence and not (fence[2][0] == "`" and "`" in fence[3]):
            close = re.compile(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            body = [_dedent(x, len(fence[1])) for x in raw[i + 1 : j]]
            out.append(Block("code", "\n".join(body).rstrip(), 0, fence[3].strip() or None))
            i = j + 1
        elif RULE.match(line):
            out.append(Block("rule"))
            i += 1
        elif QUOTE.match(line):
            inner = []
            while i < len(lines) and lines[i].strip():
                mark = QUOTE.match(lines[i])
                if not mark and (_starts_block(lines[i]) or not inner or not inner[-1].strip()):
                    break
                inner.append(lines[i][mark.end() :] if mark else lines[i])
                i += 1
            out.append(Block("quote", inner=tokenize("\n".join(inner), tables)))
        elif ITEM.match(line):
            i = _list(lines, i, out, tables)
        elif (end := _html(lines, i)) is not None:
            out.append(Block("html"))
            i = end
        else:
            i = _paragraph(lines, i, out, tables)
    return out


def _list(lines: list[str], i: int, out: list[Block], tables: bool) -> int:
    """One list: consecutive items of one kind, with what is indented below them."""
    first = ITEM.match(lines[i])
    kind = first[2][-1] if first[2][0].isdigit() else first[2]
    block = Block("ordered" if first[2][0].isdigit() else "bullet")
    while i < len(lines):
        item = ITEM.match(lines[i])
        if not item or RULE.match(lines[i]) or (item[2][-1] if item[2][0].isdigit() else item[2]) != kind:
            break
        gap = len(item[3] or " ")
        body = item.end() if gap <= 4 else item.end() - gap + 1
        width = body if lines[i][item.end() :].strip() else len(item[1]) + len(item[2]) + 1
        inner = [lines[i][body:]]
        i += 1
        blank = False
        while i < len(lines):
            if not lines[i].strip():
                blank = True
                inner.append("")
            elif _indent(lines[i]) >= width:
                blank = False
                inner.append(lines[i][width:])
            elif blank or _starts_block(lines[i]) or ITEM.match(lines[i]):
                break
            else:
                inner.append(lines[i].lstrip())
            i += 1
        block.inner += tokenize("\n".join(inner), tables)
    out.append(block)
    return i


def _paragraph(lines: list[str], i: int, out: list[Block], tables: bool) -> int:
    if tables and "|" in lines[i] and i + 1 < len(lines) and DASHES.match(lines[i + 1]) and len(_cells(lines[i])) == len(_cells(lines[i + 1])):
        width = len(_cells(lines[i]))
        j = i + 2
        while j < len(lines) and lines[j].strip() and not _starts_block(lines[j]):
            j += 1
        rows = [_cells(lines[i]), *((_cells(x) + [""] * width)[:width] for x in lines[i + 2 : j])]
        shown = ["| " + " | ".join(r) + " |" for r in rows]
        out.append(Block("table", "\n".join([shown[0], "|" + "|".join(["---"] * width) + "|", *shown[1:]])))
        return j
    held = [lines[i].strip()]
    i += 1
    while i < len(lines) and lines[i].strip():
        under = SETEXT.match(lines[i])
        if under and (title := _undefined("\n".join(held))):
            out.append(Block("heading", title, 1 if under[1][0] == "=" else 2))
            return i + 1
        if _starts_block(lines[i]):
            break
        held.append(lines[i].strip() if i + 1 == len(lines) or not lines[i].endswith("  ") else lines[i].lstrip())
        i += 1
    text = _undefined("\n".join(held)).strip()
    if text:
        out.append(Block("paragraph", text))
    return i


def _undefined(text: str) -> str:
    """A paragraph's text without the link reference definitions that it begins with."""
    while found := DEFINITION.match(text):
        text = text[found.end() :]
    return text


def _inline(blocks: list[Block]) -> list[str]:
    """The inline texts of blocks, however deep; code has none."""
    out = []
    for b in blocks:
        out += _inline(b.inner) if b.inner else [b.text] if b.kind in ("paragraph", "heading") else []
    return out


def flat_blocks(text: str, tables: bool = False) -> list[dict]:
    """Top-level blocks with their text as a chunk shows it; rules and HTML are left out."""
    out = []
    for b in tokenize(text, tables):
        if b.kind == "quote":
            out.append({"kind": "blockquote", "level": 0, "text": "> " + "\n> ".join(_inline(b.inner)), "language": None})
        elif b.kind == "bullet":
            out.append({"kind": "list", "level": 0, "text": "\n".join(f"- {t}" for t in _inline(b.inner)), "language": None})
        elif b.kind == "ordered":
            out.append({"kind": "list", "level": 0, "text": "\n".join(f"{n}. {t}" for n, t in enumerate(_inline(b.inner), 1)), "language": None})
        elif b.kind == "code":
            out.append({"kind": "code_block", "level": 0, "text": b.text, "language": b.language})
        elif b.kind in ("heading", "paragraph", "table"):
            out.append({"kind": b.kind, "level": b.level, "text": b.text, "language": None})
    return [b for b in out if b["kind"] in ("heading", "code_block") or b["text"].strip()]


def blocks(raw: Column, tables: bool = False) -> Column:
    """The blocks of a column of Markdown texts; null and empty texts have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda t: flat_blocks(t or "", tables))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, BLOCKS).asNondeterministic()(raw)


def outline(items: Column) -> Column:
    """Paragraphs and sections from blocks (kind, level, text, language).

    A heading opens a section under the nearest earlier one of a lesser level; other blocks belong
    to the section open at their place, or to an implicit one, of level 0 and first in order.
    """

    def sections(heads: Column, leading: Column) -> Column:
        shift = F.when(leading, F.lit(1)).otherwise(F.lit(0))
        numbered = F.transform(heads, lambda h, i: F.struct((i + shift).alias("ord"), h["text"].alias("title"), h["level"].alias("level")))

        def step(path: Column, h: Column) -> tuple[Column, Column]:
            # The path holds the headings that are still open, a deeper one after each.
            above = F.filter(path, lambda e: e["level"] < h["level"])
            made = F.struct(h["ord"].alias("section_ord"), h["title"].alias("title"), h["level"].alias("level"), F.get(F.reverse(above), F.lit(0))["ord"].alias("parent_ord"))
            return F.concat(above, F.array(F.struct(h["level"].alias("level"), h["ord"].alias("ord")))), F.array(made)

        named = gather(numbered, F.array().cast("array<struct<level:int,ord:int>>"), step, SECTION)
        implicit = F.array(F.struct(F.lit(0).alias("section_ord"), F.lit("").alias("title"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent_ord")))
        return F.when(leading, F.concat(implicit, named)).otherwise(named)

    def of(bs: Column) -> Column:
        heads = F.filter(bs, lambda b: b["kind"] == "heading")
        leading = F.coalesce(F.get(bs, F.lit(0))["kind"] != "heading", F.lit(False))

        def step(title: Column, b: Column) -> tuple[Column, Column]:
            head = b["kind"] == "heading"
            made = F.struct(
                F.lit(0).alias("idx"), b["text"].alias("text"), b["kind"].alias("element_type"), b["kind"].isin("code_block", "table").alias("is_atomic"),
                b["language"].alias("language"), F.lit(None).cast("int").alias("source_idx"), title.alias("section"),
            )
            return F.when(head, b["text"]).otherwise(title), F.when(~head, F.array(made)).otherwise(F.array().cast(PARAGRAPHS))

        found = gather(bs, F.lit(""), step, PARAGRAPH)
        paragraphs = F.transform(found, lambda p, i: p.withField("idx", i))
        return F.struct(paragraphs.alias("paragraphs"), let(heads, lambda h: sections(h, leading)).alias("sections"))

    return let(items, of).cast(PARSED)


def parse(raw: Column, tables: bool = False) -> Column:
    return outline(blocks(raw, tables))
