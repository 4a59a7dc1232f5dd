"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages and weighed by TF-IDF over the benchmark's
vocabulary; document frequencies count every passage of the corpus. A randomised SVD of the
passages (a Nystrom sketch whose partial products tasks compute and sum) gives the latent space;
all benchmark passages and all the corpus, by half passages, span it. Every passage of every document
is then projected, and its cosine with each benchmark passage is compared with the cosine that
full containment in so long a passage would give: SHARE of it makes a candidate. A candidate is a
leak if the longest common subsequence of words covers most of the item, in the words around the
passage, or enough of it together with enough of the item's answer, its rarest words.

Of an item of a few words a subsequence is found anywhere. Such an item has to stand word by word,
and to say enough: were its words independent, it would be expected by chance in fewer than one of
CHANCE corpora of this size. A single word never says that much, and so is never a leak.

The benchmark is the query set: word statistics of all of it are one pass over the documents, and
it is worked through in blocks of ITEMS items, in the order of their ids, each a pass to span its
space and one to search, so what a task holds is bounded. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table
from .tokens import Words, slices

#: Words in half a passage: a passage is two halves, and starts every HALF words.
HALF = 32
#: Benchmark items in one block.
ITEMS = 4000
RANK, OVER = 192, 8
#: Not read any more: every document spans the latent space. A test still sets it.
SAMPLE = 4000
#: Terms whose sums travel as one row.
TERMS = 512
#: Rows of a group that are added one at a time; what a larger group has beyond is summed at once.
STEPS = 64
#: Weight of the benchmark's passages against the corpus's, as energy.
EMPHASIS = 4.0
#: Least cosine, as a share of what a passage of that length has if it holds the whole benchmark passage.
SHARE = 0.4
#: Least share of an item's words in the common subsequence: without, and with, so much of its answer.
MOST, LCS, ANSWER = 0.75, 0.6, 0.5
#: Items of fewer words must stand word by word, and not be expected by chance in one of so many corpora.
BRIEF, CHANCE = 8, 100.0
#: Bytes of text projected at once.
SIZE = 1 << 17


def _slices(texts: pa.Array) -> Iterator[Words]:
    """Slices of lower-case texts; ASCII marks part words."""
    yield from slices(pc.utf8_lower(texts), marks=True, size=SIZE)


def _words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for w in _slices(pa.array(texts, pa.large_string())):
        out += [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return out


def _sums(group: np.ndarray, rows: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``rows[item]`` by group, for groups up to ``n``.

    One row of every group at a time, larger groups first, so that each step adds rows to a block
    from the top: much faster than summing by segments, which is left for very large groups.
    """
    out = np.zeros((n, rows.shape[1]), np.float32)
    if not len(group):
        return out
    count = np.bincount(group, minlength=n)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    by_group = np.argsort(group, kind="stable")
    group, item = group[by_group], item[by_group]
    begin = np.cumsum(count) - count
    place = np.arange(len(group)) - begin[group]
    turn = np.argsort(np.minimum(place, STEPS) * n + rank[group], kind="stable")
    ends = np.searchsorted(np.minimum(place, STEPS)[turn], np.arange(STEPS + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a == b:
            break
        out[: b - a] += rows[item[turn[a:b]]]
    if ends[-1] < len(turn):
        rest = turn[ends[-1] :]
        top = rank[group[rest]]
        cut = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        out[top[cut]] += np.add.reduceat(rows[item[rest]], cut, axis=0)
    return out[rank]


class Halves:
    """The vocabulary's words of a slice, by the half passage they stand in."""

    def __init__(self, words: Words, vocabulary: np.ndarray):
        counts = np.diff(words.bounds)
        per_doc = -(-counts // HALF)
        base = np.cumsum(per_doc) - per_doc
        doc = words.doc()
        rank = np.arange(len(words.hash)) - words.bounds[:-1][doc]
        half = base[doc] + rank // HALF
        at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        known = vocabulary[at] == words.hash
        self.term, self.half = at[known], half[known]
        self.doc = np.repeat(np.arange(len(counts)), per_doc)
        self.first = words.bounds[:-1][self.doc] + (np.arange(len(self.doc)) - base[self.doc]) * HALF
        self.n = len(self.doc)

    def project(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights' rows over each half's words."""
        return _sums(self.half, weights, self.term, self.n)

    def passages(self, halves: np.ndarray) -> np.ndarray:
        """Each half together with the next of its document."""
        out = halves.copy()
        if self.n > 1:
            out[:-1] += np.where((self.doc[1:] == self.doc[:-1])[:, None], halves[1:], 0)
        return out


def _total(docs: DataFrame, work: Callable[[Words], np.ndarray], size: int, width: int) -> np.ndarray:
    """The sum of ``work`` (size, width) over all texts: by each task, then by rows of TERMS terms."""
    parts = -(-size // TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for batch in batches:
            for words in _slices(batch.column("text")):
                total += work(words)
        for k in range(parts):
            some = total[k * TERMS : (k + 1) * TERMS]
            if some.any():
                yield pa.record_batch([pa.array([k]), pa.array([some.astype(np.float32).tobytes()], pa.binary())], names=["part", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("part").to_pylist(), batch.column("blob")):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(blob.as_buffer(), np.float32).astype(float)
        for k, x in sums.items():
            yield pa.record_batch([pa.array([k]), pa.array([x.tobytes()], pa.binary())], names=["part", "blob"])

    kind = "part long, blob binary"
    out = np.zeros((size, width))
    for r in docs.mapInArrow(run, kind).repartition(parts, "part").mapInArrow(add, kind).toLocalIterator():
        k = r["part"]
        out[k * TERMS : (k + 1) * TERMS] = np.frombuffer(r["blob"], float).reshape(-1, width)
    return out


@dataclass
class Index:
    """One block of the benchmark: its items' words, their passages, and the latent space."""

    ids: list
    items: list[np.ndarray]
    answers: list[np.ndarray]
    telling: np.ndarray  # whether an item's words say enough for a brief one
    vocabulary: np.ndarray
    weights: np.ndarray  # IDF times latent directions, a row per term
    queries: np.ndarray  # latent benchmark passages
    owner: np.ndarray  # item of each


@dataclass
class Statistics:
    """Counts over all passages of the corpus, for all of the benchmark's words, and the documents."""

    vocabulary: np.ndarray
    found: np.ndarray  # passages with each word
    passages: int
    docs: DataFrame

    def idf(self, vocabulary: np.ndarray) -> np.ndarray:
        found = self.found[np.searchsorted(self.vocabulary, vocabulary)]
        return np.maximum(np.log((1.0 + self.passages) / (1.0 + found)), 1e-3).astype(np.float32)


def statistics(docs: DataFrame, benchmark: DataFrame) -> Statistics:
    """One pass over the documents: a row per task and word that it has, added up by word."""
    words = [w for block in _blocks(benchmark) for w in [np.unique(np.concatenate([np.zeros(0, np.uint64), *_words([t for _, t in block])]))]]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    size = len(vocabulary)
    if not size:
        return Statistics(vocabulary, np.zeros(0), 0, docs.select("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for w in _slices(batch.column("text")):
                h = Halves(w, vocabulary)
                pairs = np.unique(h.half * size + h.term)
                total += np.append(np.bincount(pairs % size, minlength=size), h.n)
        term = np.flatnonzero(total)
        yield pa.record_batch([pa.array(term), pa.array(total[term])], names=["term", "n"])

    counts = np.zeros(size + 1, np.int64)
    for r in docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["term"]] = r["n"]
    return Statistics(vocabulary, counts[:size], int(counts[size]), docs.select("text"))


def build(known: Statistics, rows: list[tuple]) -> Index | None:
    """The index of a block of (item_id, text); items without a word are left out."""
    words = _words([t or "" for _, t in rows])
    kept = [k for k, w in enumerate(words) if len(w)]
    if not kept:
        return None
    ids, items = [rows[k][0] for k in kept], [words[k] for k in kept]
    vocabulary = np.unique(np.concatenate(items))
    size = len(vocabulary)
    idf = known.idf(vocabulary)

    # Benchmark passages: at most a passage's words, stepping by half of one.
    owner, terms = [], []
    for k, w in enumerate(items):
        t = np.searchsorted(vocabulary, w)
        for at in range(0, max(1, len(t) - HALF), HALF) if len(t) > 2 * HALF else [0]:
            owner.append(k)
            terms.append(t[at : at + 2 * HALF])
    begin = np.cumsum([0, *map(len, terms)])[:-1]
    flat = np.concatenate(terms)
    of = np.repeat(np.arange(len(terms)), [len(t) for t in terms])

    width = min(RANK + OVER, size)
    omega = np.random.default_rng(3).standard_normal((size, width)).astype(np.float32)

    def products(term: np.ndarray, passage: np.ndarray, projected: np.ndarray) -> np.ndarray:
        """The transposed TF-IDF matrix times ``projected``, by term."""
        out = np.empty((size, projected.shape[1] + 1))
        out[:, :-1] = _sums(term, projected, passage, size) * idf[:, None]
        # The last column adds up the energy, the sum of squared weights.
        out[:, -1] = np.bincount(term, minlength=size) * idf**2
        return out

    scaled = omega * idf[:, None]

    def sketch(w: Words) -> np.ndarray:
        h = Halves(w, vocabulary)
        return products(h.term, h.half, h.project(scaled))

    corpus = _total(known.docs, sketch, size, width + 1)
    bench = products(flat, of, np.add.reduceat(scaled[flat], begin, axis=0))
    scale = EMPHASIS * max(corpus[:, -1].sum(), 1e-9) / bench[:, -1].sum()
    y = bench[:, :-1] * scale + corpus[:, :-1]
    shift = 1e-6 * np.linalg.norm(y)
    y = y + shift * omega
    core = omega.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-9 * value[-1]
    latent, _, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    weights = (latent[:, :RANK] * idf[:, None]).astype(np.float32)
    queries = np.add.reduceat(weights[flat], begin, axis=0)
    say = np.array([idf[np.searchsorted(vocabulary, w)].sum() for w in items])
    telling = say >= np.log(1.0 + known.passages) + np.log(CHANCE)
    answers = [w[np.argsort(-idf[np.searchsorted(vocabulary, w)], kind="stable")[: max(1, len(w) // 4)]] for w in items]
    return Index(ids, items, answers, telling, vocabulary, weights, queries, np.array(owner))


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of a long integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _contains(span: np.ndarray, item: np.ndarray) -> bool:
    """Whether the item's words stand in the span one after the other."""
    if len(span) < len(item):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(span, len(item)) == item).all(axis=1).any())


def _leaks(words: Words, index: Index) -> dict[int, dict[int, tuple[float, float, float]]]:
    """row -> item -> (share of the item in common, share of its answer, cosine)."""
    found: dict[int, dict[int, tuple[float, float, float]]] = {}
    h = Halves(words, index.vocabulary)
    if not len(h.term):
        return found
    p = h.passages(h.project(index.weights))
    long, wide = np.linalg.norm(index.queries, axis=1), np.linalg.norm(p, axis=1)
    dots = p @ index.queries.T
    # cosine >= SHARE * min(1, long / wide), both sides times the lengths
    for at, q in np.argwhere((wide[:, None] > 0) & (dots >= SHARE * long * np.minimum(wide[:, None], long))):
        cosine = float(dots[at, q] / max(1e-9, wide[at] * long[q]))
        row, k = int(h.doc[at]), int(index.owner[q])
        item = index.items[k]
        margin = max(HALF, len(item))
        low = max(int(words.bounds[row]), int(h.first[at]) - margin)
        high = min(int(words.bounds[row + 1]), int(h.first[at]) + 2 * HALF + margin)
        span = words.hash[low:high]
        if len(item) < BRIEF:
            common = float(index.telling[k] and _contains(span, item))
        else:
            common = lcs(item, span) / len(item)
        if common < LCS:
            continue
        answer = float(np.isin(index.answers[k], span).mean())
        if common < MOST and answer < ANSWER:
            continue
        best = found.setdefault(row, {})
        best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (common, answer, min(1.0, cosine)))
    return found


VALUES = ["common", "answer", "cosine"]


def _leak_rows(batches: Iterator[pa.RecordBatch], index: Index, item: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ids, out = [], [], []
        for words in _slices(batch.column("text")):
            for row, items in sorted(_leaks(words, index).items()):
                for k, values in sorted(items.items()):
                    at.append(words.rows.start + row)
                    ids.append(index.ids[k])
                    out.append([round(x, 6) for x in values])
        columns = zip(*out) if out else [[]] * len(VALUES)
        yield pa.record_batch(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ids, item), *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", "item_id", *VALUES]
        )


def _clean_rows(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for words in _slices(batch.column("text")):
            for row in _leaks(words, index):
                keep[words.rows.start + row] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items with a text in the order of id and text, ITEMS at a time."""
    block: list[tuple] = []
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per row of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` found in it.

    ``common`` is the share of the item's words in the longest common subsequence, ``answer`` that
    of its rarest words, ``cosine`` the latent one. Case and punctuation are ignored. Null and
    empty texts and items match nothing; repeated rows and items are each reported; ids, of any
    type, are reported as they are, null too; other columns are ignored; without documents or items
    the result is empty. An item of a few words is found only word by word, and not at all where
    its words are too common to tell it from chance.
    """
    docs = docs.select("doc_id", "text")
    known, parts = statistics(docs, benchmark), []
    item = benchmark.schema["item_id"].dataType
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item), *(T.StructField(x, T.DoubleType()) for x in VALUES)])
    for block in _blocks(benchmark):
        index = build(known, block)
        if index is not None:
            parts.append(docs.mapInArrow(lambda it, index=index, kind=to_arrow_type(item): _leak_rows(it, index, kind), shape))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], shape)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns. One pass for all blocks."""
    known = statistics(docs.select("doc_id", "text"), benchmark)
    for block in _blocks(benchmark):
        index = build(known, block)
        if index is not None:
            docs = docs.mapInArrow(lambda it, index=index: _clean_rows(it, index), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
