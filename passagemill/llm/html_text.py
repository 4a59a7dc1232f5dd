"""Main text of web pages by a tree-structured graphical model of the DOM.

Every block element is a node with a hidden label, content or not. Node
potentials come from its tag, its class and id, and how much text and how many
links it and its subtree hold; edge potentials tie it to its parent. Messages go
upward and downward by sum-product, which is exact on a tree, and a block of
text belongs to the article if its node's content marginal is at least one half.

The weights are trained by maximum likelihood (the gradient is observed minus
expected counts, the latter from the same messages) on labelled pages that
:func:`labelled_pages` lays out: a fixed number, so training is a constant cost.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|button)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that open a node; all others are inline or ignored.
TAGS = [
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "tr", "td", "th", "thead", "tbody", "caption", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer",
    "aside", "form", "fieldset", "label", "address", "center", "details", "summary", "hgroup",
]
TAG = {t: i + 1 for i, t in enumerate(TAGS)}
BREAKS = {"br", "hr", "head"}
#: What a class, id or role may say, first match; 0 is none, the last is any other name.
NAMES = [
    re.compile(p, re.I)
    for p in (
        r"comment|discuss|repl(?:y|ies)|disqus",
        r"\bads?\b|advert|sponsor|promo|banner",
        r"nav|menu|breadcrumb|pagination|pager|toc\b",
        r"side-?bar|aside|related|widget|recommend|trending",
        r"cookie|consent|notice|popup|modal|newsletter|subscri|signup|login|alert",
        r"foot|copyright|legal",
        r"share|social|tags?\b|meta\b|byline|author",
        r"content|article|post|entry|story|main|body",
        r"head|masthead|logo|top-?bar",
    )
]
#: Start tags that end an open element of the tags given, up to the containers given.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "nav"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: What only the small print says.
LEGAL = re.compile(r"&copy;|©|&#169;|\bcopyright\b|all rights reserved", re.I)
#: Tags that say what stands inside them, however deep.
SECTIONS = ["article", "main", "aside", "nav", "header", "footer", "form", "address"]
FEATURES = ["tag", "name", "own", "below", "links", "first", "share", "within", "inside", "legal"]
SIZES = {"tag": len(TAGS) + 1, "name": len(NAMES) + 2, "own": 10, "below": 12, "links": 5, "first": 3, "share": 7, "within": len(NAMES) + 2, "inside": len(SECTIONS) + 1, "legal": 2}
OFFSETS = dict(zip(FEATURES, np.cumsum([0, *SIZES.values()])[:-1].tolist()))
WIDTH = sum(SIZES.values())


class Tree:
    """Nodes of one page in page order, and its blocks of text as (node, text)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.depth = ["html"], [0], [0]
        self.name, self.marks = [0], [""]
        self.own, self.linked, self.legal = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack, run, at, link = [0], [], 0, False

        def text(raw: str) -> None:
            if raw:
                run.append(raw)
                n = len(raw.strip())
                self.legal[stack[-1]] |= LEGAL.search(raw) is not None
                self.own[stack[-1]] += n
                if link:
                    self.linked[stack[-1]] += n

        def flush() -> None:
            if run:
                words = html.unescape("".join(run)).split()
                run.clear()
                if words:
                    self.blocks.append((stack[-1], " ".join(words)))

        for m in TOKEN.finditer(page):
            text(page[at : m.start()])
            at = m.end()
            tag = m[3]
            if not tag:
                if m[1] and m[1].lower() in ("title", "textarea", "select", "button"):
                    flush()
                continue
            tag = tag.lower()
            if tag == "a":
                link = not m[2]
            elif tag in BREAKS:
                flush()
            elif tag in TAG:
                flush()
                if m[2]:
                    self._close(stack, tag)
                else:
                    self._open(stack, tag, m[4])
        text(page[at:])
        flush()

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag == "html" or (tag == "body" and len(stack) == 1 and "body" in self.tag):
            return
        if self.tag[stack[-1]] == "p":
            stack.pop()
        if tag in CLOSES:
            ends, inside = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in inside:
                    break
                if self.tag[stack[k]] in ends:
                    del stack[k:]
                    break
        names = " ".join(filter(None, (g for m in NAMED.findall(attributes) for g in m))) if attributes else ""
        kind = 0
        if names:
            kind = next((i + 1 for i, p in enumerate(NAMES) if p.search(names)), len(NAMES) + 1)
        self.parent.append(stack[-1])
        self.depth.append(self.depth[stack[-1]] + 1)
        self.tag.append(tag)
        self.name.append(kind)
        self.marks.append(attributes)
        self.own.append(0)
        self.linked.append(0)
        self.legal.append(0)
        stack.append(len(self.tag) - 1)

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return


class Forest:
    """All nodes of several pages in arrays, with their features."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.tag) for t in trees])
        self.starts = np.cumsum(sizes) - sizes
        shift = np.repeat(self.starts, sizes)
        n = int(sizes.sum())
        flat = lambda name: np.fromiter((x for t in trees for x in getattr(t, name)), np.int64, n)
        self.parent, self.depth = flat("parent") + shift, flat("depth")
        own, linked = flat("own"), flat("linked")
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        below, links = own.copy(), linked.copy()
        for idx in self.levels[:0:-1]:
            np.add.at(below, self.parent[idx], below[idx])
            np.add.at(links, self.parent[idx], links[idx])
        bits = lambda x: np.ceil(np.log2(x + 1.0)).astype(np.int64)
        density = np.where(below > 0, np.minimum(4, 1 + 4 * links // np.maximum(below, 1)), 0)
        tags = np.fromiter((TAG.get(x, 0) for t in trees for x in t.tag), np.int64, n)
        first = np.ones(n, np.int64)
        first[0] = 0
        same = (self.parent[1:] == self.parent[:-1]) & (tags[1:] == tags[:-1])
        first[1:] = np.where(same, 2, np.where(self.parent[1:] == np.arange(n - 1), 0, 1))
        whole = np.repeat(np.maximum(1, below[self.starts]), sizes)
        part = np.where(below > 0, 1 + np.minimum(5, np.floor(-np.log2(np.maximum(below, 1) / whole))).astype(np.int64), 0)
        name = flat("name")
        within = name.copy()  # the nearest name from the node upward
        kinds = np.zeros(len(TAGS) + 1, np.int64)
        kinds[[TAG[x] for x in SECTIONS]] = np.arange(1, len(SECTIONS) + 1)
        inside = kinds[tags]  # and the nearest such tag
        for idx in self.levels[1:]:
            within[idx] = np.where(name[idx] > 0, name[idx], within[self.parent[idx]])
            inside[idx] = np.where(inside[idx] > 0, inside[idx], inside[self.parent[idx]])
        columns = {"legal": flat("legal"), "inside": inside, "share": part, "within": within, "tag": tags, "name": name, "own": np.minimum(9, bits(own)), "below": np.minimum(11, bits(below)), "links": density, "first": first}
        self.x = np.stack([columns[f] + OFFSETS[f] for f in FEATURES], axis=1)

    def marginals(self, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of every node, and the expected count of each (parent, child) label pair."""
        belief = np.zeros((len(self.x), 2))
        belief[:, 1] = node[self.x].sum(axis=1)
        up = np.zeros_like(belief)
        for idx in self.levels[:0:-1]:
            up[idx] = np.logaddexp(belief[idx, :1] + edge[:, 0], belief[idx, 1:] + edge[:, 1])
            np.add.at(belief, self.parent[idx], up[idx])
        full, pairs = belief.copy(), np.zeros((2, 2))
        for idx in self.levels[1:]:
            rest = full[self.parent[idx]] - up[idx]
            joint = rest[:, :, None] + edge[None] + belief[idx][:, None, :]
            top = joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint - top)
            pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            full[idx] = belief[idx] + np.logaddexp(rest[:, 0, None] + edge[0], rest[:, 1, None] + edge[1])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700))), pairs


def labelled_pages(pages: int, seed: int) -> list[str]:
    """Pages whose content elements carry ``data-y``, which no feature looks at.

    Layouts: article, main, named and plain divs, nested sections, layout tables, text right in the
    body; with and without menus, headers, footers; notices, adverts, asides, forms, share boxes
    and reader comments before, in and after the text; long, brief and empty pages.
    """
    rng = random.Random(seed)
    chance = lambda p: rng.random() < p

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def name(*names: str) -> str:
        return f'{rng.choice(["id", "class"])}="{rng.choice(names)}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(n))

    def line_of_links() -> str:
        return rng.choice([" ", " | ", "<br>"]).join(f'<a href="/x">{words(1, 3)}</a>' for _ in range(rng.randint(1, 6)))

    def paragraph() -> str:
        text = words(1, 12) if chance(0.3) else words(8, 120)
        text = f"<b>{text}</b>" if chance(0.1) else text
        return f"<p data-y>{text} <a href='/y'>{words(1, 2)}</a> {words(1, 9)}</p>" if chance(0.15) else f"<p data-y>{text}</p>"

    def body_block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return paragraph()
        if kind < 0.78:
            return f"<h{(h := rng.randint(2, 4))} data-y>{words(1, 7)}</h{h}>"
        if kind < 0.86:
            return f"<{(t := rng.choice(['ul', 'ol']))} data-y>" + "".join(f"<li data-y>{words(2, 20)}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>"
        if kind < 0.9:
            return f"<blockquote data-y><p data-y>{words(5, 40)}</p></blockquote>" if chance(0.7) else f"<blockquote data-y>{words(5, 40)}</blockquote>"
        if kind < 0.94:
            return f"<pre data-y>{words(3, 30)}</pre>"
        cell = rng.choice(["td", "th"])
        rows = [f"<tr data-y><{t} data-y>{words(1, 5)}</{t}><{t} data-y>{words(1, 5)}</{t}></tr>" for t in [cell, "td", "td", "td"][: rng.randint(2, 4)]]
        return "<table data-y>" + "".join(rows) + "</table>"

    def aside() -> str:
        inner = (f"<h3>{words(1, 4)}</h3>" if chance(0.5) else "") + f"<p>{words(4, 40)}</p>" * chance(0.8) + (f"<ul>{links(4)}</ul>" if chance(0.4) else "")
        return f"<aside>{inner or words(4, 20)}</aside>" if chance(0.6) else f"<div {name('sidebar', 'side', 'related', 'widget', 'right-sidebar')}>{inner or words(4, 20)}</div>"

    def clutter() -> str:
        return rng.choice(
            [
                lambda: f'<div {name("ad", "ads", "advert", "banner", "sponsored", "promo-box")}>{words(3, 25)}</div>',
                lambda: f'<div {name("share-buttons", "share", "social-links")}>{line_of_links()}</div>',
                lambda: f'<div {name("related", "newsletter-signup", "promo", "related-posts", "trending")}>{f"<h4>{words(1, 3)}</h4>" * chance(0.4)}<p>{words(2, 20)}</p><ul>{links(3)}</ul></div>',
                lambda: f'<div {name("related", "recommended", "more-stories widget")}><h4>{words(1, 3)}</h4><ul>{links(rng.randint(2, 5))}</ul></div>',
                aside,
                aside,
                lambda: f'<form action="/s">{f"<p>{words(2, 10)}</p>" * chance(0.6)}<label>{words(1, 3)}</label><input name="q"></form>',
                lambda: f'<div {name("cookie-notice", "consent", "login-notice", "cookie-banner", "popup")}><p>{words(6, 40)}</p></div>',
                lambda: f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>",
                lambda: f"<address>{words(2, 9)} {line_of_links()}</address>",
            ]
        )()

    def comments() -> str:
        def one() -> str:
            said = f"<p>{words(1, 3)}</p>" * chance(0.5) + f"<p>{words(2, 60)}</p>"
            return rng.choice([f'<div class="comment">{said}</div>', f"<li>{said}</li>", said, f'<article class="comment">{said}</article>'])

        several = "".join(one() for _ in range(rng.randint(1, 6)))
        several = f"<{(t := rng.choice(['ul', 'ol', 'div']))}>{several}</{t}>" if chance(0.5) else several
        box = name("comments", "discussion", "comment-list", "disqus_thread", "replies")
        return f'<{(t := rng.choice(["section", "div"]))} {box}>{f"<h3>{words(1, 3)}</h3>" * chance(0.6)}{several}</{t}>'

    def menu() -> str:
        shape = rng.random()
        if shape < 0.5:
            return f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>"
        if shape < 0.6:
            return f"<nav>{line_of_links()}</nav>"
        return f'<div {name("menu", "nav", "topbar", "top", "navigation", "x1")}>' + (f"<ul>{links(rng.randint(2, 7))}</ul>" if chance(0.6) else line_of_links()) + "</div>"

    def foot() -> str:
        said = f"{'&copy; ' * chance(0.7)}{words(2, 30)} {line_of_links() * chance(0.4)}"
        said = f"<p>{said}</p>" if chance(0.4) else said
        return f"<footer>{said}</footer>" if chance(0.75) else f"<div {name('footer', 'bottom', 'legal', 'foot')}>{said}</div>"

    out = []
    for _ in range(pages):
        head = f"<h{(h := 1 if chance(0.7) else 2)} data-y>{words(1, 9)}</h{h}>" if chance(0.85) else ""
        brief = chance(0.3)  # a few lines, and perhaps a title
        head = "" if brief and chance(0.4) else head
        inner = head
        for _ in range(rng.randint(1, 4) if brief else rng.randint(0 if head else 1, 14)):
            inner += f"<p data-y>{words(1, 6)}</p>" if brief else body_block()
            if chance(0.08):
                inner += clutter()
        late = comments() if chance(0.35) else ""
        if chance(0.5):
            inner, late = inner + late, ""
        shape = rng.random()
        bare = chance(0.2)  # neither menu nor footer
        if shape < 0.35:
            main = f"<article data-y>{inner}</article>"
        elif shape < 0.45:
            main = f"<main data-y>{inner}</main>" if chance(0.4) else f'<main data-y><div data-y class="{rng.choice(["content", "post-body", "entry"])}">{inner}</div></main>'
        elif shape < 0.6:
            main = f'<div data-y {name("content", "article-body", "main", "story")}>{inner}</div>'
            main = f'<div data-y {name("wrapper", "container", "post")}>{main}</div>' if chance(0.3) else main
        elif shape < 0.7:
            main = f"<div data-y>{inner}</div>" if chance(0.6) else f"<div data-y><div data-y>{inner}</div></div>"
        elif shape < 0.78:
            parts = "".join(f"<section data-y><h3 data-y>{words(1, 5)}</h3>{body_block()}{paragraph()}</section>" for _ in range(rng.randint(1, 3)))
            main = f"<{(t := rng.choice(['section', 'div', 'article']))} data-y><section data-y>{inner}</section>{parts}</{t}>"
        elif shape < 0.92:
            side = lambda: rng.choice([line_of_links(), f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{words(2, 12)}</p>{line_of_links()}"])
            cells = [f"<td width=150>{side()}</td>" * chance(0.6), f"<td data-y>{inner}</td>", f"<td>{side()}</td>" * chance(0.5)]
            rows = [f"<tr><td>{line_of_links()}</td></tr>" * chance(0.5), f"<tr>{''.join(cells)}</tr>", f"<tr><td>&copy; {words(2, 12)} {line_of_links()}</td></tr>" * chance(0.5)]
            main = f"<table{rng.choice(['', ' width=600', ' border=0'])}>{''.join(rows)}</table>"
            main = f"<center>{main}</center>" if chance(0.2) else main
        else:
            main = inner
        top = f"<header><h1>{words(1, 3)}</h1><p>{words(2, 9)}</p></header>" if chance(0.3) else f"<header><a href='/'>{words(1, 3)}</a></header>" * chance(0.3)
        top += menu() + "".join(clutter() for _ in range(rng.randint(0, 2)))
        end = late + "".join(clutter() for _ in range(rng.randint(0, 2))) + foot()
        if bare:
            top, end = "", late
        elif chance(0.3):
            end = late + f"<address>{words(2, 9)} {line_of_links()}</address>" * chance(0.8)
        if chance(0.06):  # no text at all
            main = f"<form><input name='q'><button>{words(1, 2)}</button></form>" * chance(0.5)
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>{top}{main}{end}</body></html>")
    return out


def train(pages: int = 900, seed: int = 11, epochs: int = 300, rate: float = 0.08, weight: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge potentials that make the labelled pages most likely (Adam, light decay)."""
    trees = [Tree(p) for p in labelled_pages(pages, seed)]
    forest = Forest(trees)
    y = np.fromiter((int("data-y" in m) for t in trees for m in t.marks), np.int64, len(forest.x))
    theta = np.zeros(WIDTH + 4)
    inner = np.concatenate(forest.levels[1:])
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[forest.parent[inner]], y[inner]), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        p, pairs = forest.marginals(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
        grad = np.zeros_like(theta)
        np.add.at(grad[:WIDTH], forest.x.ravel(), np.repeat(y - p, forest.x.shape[1]))
        grad[WIDTH:] = (seen_pairs - pairs).ravel()
        grad = grad / len(y) - weight * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


#: Pages whose trees are held at once.
GROUP = 256
OUT_ROW = "page_id long, url string, text string, n_chars long, confidence double"


def extract(pages: list[str], node: np.ndarray, edge: np.ndarray) -> list[tuple[str, float]]:
    """Main text of each page, and how sure its least sure block is."""
    trees = [Tree(p) for p in pages]
    forest = Forest(trees)
    content, _ = forest.marginals(node, edge)
    out = []
    for tree, start in zip(trees, forest.starts.tolist(), strict=True):
        sure = [content[start + k] for k, _ in tree.blocks]
        text = " ".join(b for (_, b), p in zip(tree.blocks, sure, strict=True) if p >= 0.5)
        out.append((text, float(min((max(p, 1 - p) for p in sure), default=1.0))))
    return out


def _extract_rows(batches: Iterator[pa.RecordBatch], node: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), GROUP):
            part = batch.slice(at, GROUP)
            found = extract([x.as_py() or "" for x in part.column("html")], node, edge)
            texts = pa.array([t for t, _ in found], pa.string())
            sizes = pa.array([len(t) for t, _ in found], pa.int64())
            yield pa.record_batch([part.column("page_id"), part.column("url"), texts, sizes, pa.array([round(p, 6) for _, p in found])], names=["page_id", "url", "text", "n_chars", "confidence"])


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages(page_id, url, html)``: one row each, nothing cut.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space. Null or empty html, and pages without an article, give an empty text.
    Other columns are ignored. There is no shuffle; the weights in the closure are a few KB.
    """
    node, edge = train()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(lambda it: _extract_rows(it, node, edge), OUT_ROW)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLES: dict[str, str] = {}
