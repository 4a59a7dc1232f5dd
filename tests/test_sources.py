"""Markdown blocks, PDF rules, file scans and the registry."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagemill.errors import UnsupportedTypeError
from passagemill.sources import markdown, pdf, registry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests

PAGE = """Lead text.

# Intro
Para one
continues.

Para **two**.

## Sub ##
- item a
- item b
  - nested c

3) x
4) y

> quote one
>
> > deep

~~~python title
x = 1

~~~

    indented

***
<div>gone</div>

Setext
======
end
# Last
"""


def kinds(text, **options):
    return [(b["kind"], b["text"]) for b in markdown.flat_blocks(text, **options)]


def test_markdown_blocks():
    assert kinds(PAGE) == [
        ("paragraph", "Lead text."), ("heading", "Intro"), ("paragraph", "Para one\ncontinues."), ("paragraph", "Para **two**."), ("heading", "Sub"),
        ("list", "- item a\n- item b\n- nested c"), ("list", "1. x\n2. y"), ("blockquote", "> quote one\n> deep"), ("code_block", "x = 1"), ("code_block", "indented"),
        ("heading", "Setext"), ("paragraph", "end"), ("heading", "Last"),
    ]
    assert [b["language"] for b in markdown.flat_blocks(PAGE) if b["kind"] == "code_block"] == ["python title", None]
    assert kinds("") == [] and kinds("   \n\n") == []


def texts(md, **options):
    return [(b["kind"], b["text"]) for b in markdown.flat_blocks(md, **options)]


#: Markdown -> what CommonMark makes of it: kinds and texts, HTML and definitions left out.
CASES = [
    ("<script>\nvar a;\n\nvar b;\n</script>\n\nafter", [("paragraph", "after")]),
    ("<script>var a;</script>\nafter", [("paragraph", "after")]),
    ("<PRE class='x'>\n\n# no\n</pre> rest\nafter", [("paragraph", "after")]),
    ("<style>\n\np {}", []),
    ("<!-- a\n\nb -->\nafter", [("paragraph", "after")]),
    ("<!-- one --> line\nafter", [("paragraph", "after")]),
    ("<?php\n\necho 1; ?>\nafter", [("paragraph", "after")]),
    ("<!DOCTYPE html>\nafter", [("paragraph", "after")]),
    ("<![CDATA[\n\nx\n]]>\nafter", [("paragraph", "after")]),
    ("<div>\nstill html\n\nafter", [("paragraph", "after")]),
    ("</div> text\nstill html", []),
    ("<span>\nstill html\n\nafter", [("paragraph", "after")]),
    ("<span class='a' data-b=\"c\" d=e f>  \n\nafter", [("paragraph", "after")]),
    ("</ins>\n*html*\n\nafter", [("paragraph", "after")]),
    ("<span>inline</span> stays", [("paragraph", "<span>inline</span> stays")]),
    ("text\n<span>\nmore", [("paragraph", "text\n<span>\nmore")]),
    ("text\n<div>\nhtml\n\nafter", [("paragraph", "text"), ("paragraph", "after")]),
    ("<divx y\nafter", [("paragraph", "<divx y\nafter")]),
    ("<http://a.b>", [("paragraph", "<http://a.b>")]),
    ("[foo]: http://a.b", []),
    ("[foo]: http://a.b 'Title'\n[bar]: <c d>\ntext", [("paragraph", "text")]),
    ("[foo]:\n/url\n\"a\ntitle\"\n\ntext", [("paragraph", "text")]),
    ("[foo]: http://a.b not a title", [("paragraph", "[foo]: http://a.b not a title")]),
    ("[foo] no definition", [("paragraph", "[foo] no definition")]),
    ("text\n[foo]: http://a.b", [("paragraph", "text\n[foo]: http://a.b")]),
    ("[ ]: http://a.b", [("paragraph", "[ ]: http://a.b")]),
    ("```\na\tb\n\tc\n```", [("code_block", "a\tb\n\tc")]),
    ("  ```\n  \ta\n   b\n  ```", [("code_block", "\ta\n b")]),
    ("\tfoo\tbaz\n\n\t\tbim", [("code_block", "foo\tbaz\n\n\tbim")]),
    ("  \tfoo\tbaz", [("code_block", "foo\tbaz")]),
    ("text\n\tlazy", [("paragraph", "text\nlazy")]),
    ("# a\tb", [("heading", "a\tb")]),
    ("a\n===\nb\n---\nc", [("heading", "a"), ("heading", "b"), ("paragraph", "c")]),
    ("- a\n\n  <script>\n\n  x\n  </script>\n- b", [("list", "- a\n- b")]),
    ("> [foo]: /url\n> text", [("blockquote", "> text")]),
]


@pytest.mark.parametrize("md, want", CASES)
def test_block_structure(md, want):
    assert texts(md) == want


def test_long_documents_take_linear_time(spark):
    """Thousands of blocks in one document: a fold that copied its result took seconds."""
    import time

    many = [("heading", 1 + i % 3, f"h{i}", None) if i % 2 else ("paragraph", 0, f"p{i}", None) for i in range(40_000)]
    df = spark.createDataFrame([(1, many)], f"i int, b {markdown.BLOCKS}").cache()
    df.count()
    began = time.time()
    (row,) = df.select(F.size(markdown.outline(F.col("b"))["paragraphs"]).alias("p"), F.size(markdown.outline(F.col("b"))["sections"]).alias("s")).collect()
    assert (row["p"], row["s"]) == (20_000, 20_001) and time.time() - began < 30


def test_tables_are_text_unless_asked_for():
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n\nafter"
    assert kinds(table)[0][0] == "paragraph"
    assert kinds(table, tables=True) == [("table", "| a | b |\n|---|---|\n| 1 | 2 |"), ("paragraph", "after")]


def test_outline_against_a_stack(spark):
    import random

    r = random.Random(2)
    docs = [[("heading", r.randint(1, 6), f"h{i}", None) if r.random() < 0.6 else ("paragraph", 0, f"p{i}", None) for i in range(r.randint(0, 12))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(docs)), f"i int, b {markdown.BLOCKS}")
    got = {r["i"]: r["o"] for r in df.select("i", markdown.outline(F.col("b")).alias("o")).collect()}
    for i, doc in enumerate(docs):
        stack, want, title, sections = [], [], "", []
        if doc and doc[0][0] != "heading":
            sections.append((0, "", None))
        for kind, level, text, _ in doc:
            if kind == "heading":
                while stack and stack[-1][0] >= level:
                    stack.pop()
                sections.append((level, text, stack[-1][1] if stack else None))
                stack.append((level, len(sections) - 1))
                title = text
            else:
                want.append((text, title))
        assert [(p["text"], p["section"]) for p in got[i]["paragraphs"]] == want
        assert [(s["level"], s["title"], s["parent_ord"]) for s in got[i]["sections"]] == sections


def test_pdf_rules(spark):
    span = lambda b, n, s, text, size=11.0, flags=0: (0, b, n, s, text, size, flags)
    spans = [
        span(0, 0, 0, "before"), span(1, 0, 0, "Big title", 14.0), span(2, 0, 0, "Body"), span(2, 0, 1, "goes"), span(2, 1, 0, "on."),
        span(3, 0, 0, "Bold part", 12.0, 16), span(4, 0, 0, "ends with colon:", 11.0, 16), span(5, 0, 0, "Small bold", 11.0, 16), span(6, 0, 0, "  "),
    ]
    df = spark.createDataFrame([(1, spans), (2, [])], f"i int, s {pdf.SPANS}")
    rows = {r["i"]: r for r in df.select("i", pdf.outline(pdf.text_blocks(F.col("s"))).alias("o"), pdf.raw_text(F.col("s")).alias("raw")).collect()}
    assert [(p["text"], p["section"]) for p in rows[1]["o"]["paragraphs"]] == [("before", ""), ("Body goes on.", "Big title"), ("ends with colon:", "Bold part")]
    assert [(s["title"], s["level"], s["parent_ord"]) for s in rows[1]["o"]["sections"]] == [("", 0, None), ("Big title", 1, None), ("Bold part", 2, 1), ("Small bold", 3, 1)]
    assert rows[2]["o"]["paragraphs"] == [] and "before Big title" in rows[1]["raw"]


class Opened(list):
    """What PyMuPDF's documents look like to the reader."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def opened(content):
    """A PDF whose pages are the lines of a text, each line a block; capital lines are large."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")

    class Page(str):
        def get_text(self, form="text"):
            if form == "text":
                return str(self)
            image = {"type": 1}
            return {"blocks": [image] + [{"type": 0, "lines": [{"spans": [{"text": x, "size": 15.0 if x.isupper() else 10.0, "flags": 0}]}]} for x in str(self).split("|")]}

    return Opened(Page(x) for x in content.decode().split("\n")[1:])


def test_pdf_files(spark):
    rows = [("x/a.pdf", b"%PDF\nlead|ONE|body of one\nTWO|more"), ("x/b.pdf", b"broken"), ("x/c.pdf", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    reg = registry.Registry()
    reg.register("pdf", "pdf", lambda content: pdf.parse(content, opened))
    got = {r["filename"]: r for r in reg.parse(df).collect()}
    assert [(p["text"], p["section"]) for p in got["a.pdf"]["parsed"]["paragraphs"]] == [("lead", ""), ("body of one", "ONE"), ("more", "TWO")]
    assert [(s["title"], s["level"], s["parent_ord"]) for s in got["a.pdf"]["parsed"]["sections"]] == [("", 0, None), ("ONE", 1, None), ("TWO", 1, None)]
    assert got["b.pdf"]["error"] and got["c.pdf"]["parsed"] is None
    text = {r["path"]: r["t"] for r in df.select("path", pdf.page_text(F.col("content"), opened).alias("t")).collect()}
    assert text == {"x/a.pdf": "lead|ONE|body of one\nTWO|more", "x/b.pdf": None, "x/c.pdf": None}


def test_files(spark, tmp_path):
    (tmp_path / "a.MD").write_text(PAGE)
    (tmp_path / "b.txt").write_bytes("caf\xe9 one\r\n\r\ntwo  x".encode("latin-1"))
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.xyz").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    rows = {r["filename"]: r for r in registry.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.MD"]["file_type"] == "markdown" and len(rows["a.MD"]["parsed"]["paragraphs"]) == 9
    assert [p["text"] for p in rows["b.txt"]["parsed"]["paragraphs"]] == ["caf\xe9 one", "two x"]
    assert "unsupported" in rows["c.xyz"]["error"] and rows["c.xyz"]["parsed"] is None
    assert rows["bad.md"]["error"] and rows["d.pdf"]["error"] == "failed to parse pdf file"


def test_registry():
    r = registry.Registry()
    assert r.is_supported("/x/Y.Markdown") and not r.is_supported("noext")
    r.register("rst", "rst", lambda c: c)
    assert r.parser(".RST")[0] == "rst"
    r.unregister("rst")
    with pytest.raises(UnsupportedTypeError, match="txt"):
        r.parser("rst")
    r.unregister("txt")
    r.reset()
    assert ".txt" in r.extensions()


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 2, "b"), (1, 1, " a  a "), (1, 3, " "), (2, 1, None)], "conv_id long, turn long, text string")
    rows = {r["doc_id"]: [p["text"] for p in r["parsed"]["paragraphs"]] for r in registry.from_conversations(turns).collect()}
    assert rows == {1: ["a a", "b"], 2: []}
