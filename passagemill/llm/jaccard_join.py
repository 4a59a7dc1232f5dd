"""N-gram Jaccard join by signature trees.

A document is the set of its word shingles. Equal sets are one class, which its
smallest document stands for. Classes are dealt to trees by bands of min-hashes:
two sets of Jaccard similarity 0.8 share none of the BANDS bands of ROWS rows
with probability (1 - 0.8 ** 4) ** 52 < 2e-12, about that of a clash of
fingerprints, and more similar ones less. Inside a tree nothing is approximate:
its nodes hold the OR of their sets' token bitmaps, a size range and what the
bitmaps lose to clashes; a dual traversal drops the pairs of nodes whose largest
possible overlap is too small, or whose sets are connected already, and the
pairs of sets that are left are intersected exactly.

What comes out of a tree is a forest of verified links, never all pairs. It is
run twice: a few bands first connect nearly all that belongs together, then the
rest of the bands, only where a tree still spans several components. A tree of
more than CROWD sets is split in blocks, and pairs of blocks are traversed where
their sets belong to different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import before
from ..functions.text import barrier
from .common import discard, hold, materialise, table
from .tokens import U, Words, grams, mix, slices, small
from .url_filter import LOAD, MAX_BLOCKS, _block, _mask

SHINGLE = 5
#: The least similarity, in hundredths.
PERCENT = 80
BANDS, ROWS = 52, 4
#: Bands that connect most of what belongs together.
EARLY = 4
#: Sets in one tree at most; more are split in blocks.
CROWD = 2048
#: Sets below a lowest node.
LEAF = 16
#: Rows of links or labels in one written file.
FILE_ROWS = 500_000

_RNG = np.random.default_rng(97)
_FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents of a slice, ordered, and where each document's begin."""
    counts = np.diff(words.bounds)
    docs = words.doc()
    h, at = grams(words.hash, words.bounds, size)
    parts, owners = [h], [docs[at]]
    for n in range(1, size):  # a text of fewer words is one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            h, at = grams(words.hash, words.bounds, n, seed=n)
            own = docs[at]
            mine = counts[own] == n
            parts.append(h[mine])
            owners.append(own[mine])
    h, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(len(counts) + 1))


SKETCH_ROW = "did long, n long, s1 long, s2 long, bands array<long>"


def _sketch_rows(batches: Iterator[pa.RecordBatch], size: int, prefix: int = 0) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and keys of each set; with ``prefix``, the similarity in hundredths, its first shingles are its keys."""
    for batch in small(batches, 4096):
        for words in slices(batch.column("text"), lower=True):
            h, bounds = shingle_sets(words, size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            begin = bounds[:-1][full]
            s1, s2 = np.zeros(len(n), U), np.zeros(len(n), U)
            many = n - -(-n * prefix // 100) + 1 if prefix else np.full(len(n), BANDS)
            many = np.where(n > 0, many, 0)
            keys = np.zeros((len(full), BANDS), U)
            if len(full):
                s1[full] = np.add.reduceat(mix(h + U(1)), begin)
                s2[full] = np.bitwise_xor.reduceat(mix(h + U(2)), begin)
                token = (h >> U(32)).astype(np.uint32)
                for band in range(0 if prefix else BANDS):
                    key = np.full(len(full), band + 1, U)
                    for j in range(band * ROWS, band * ROWS + ROWS):
                        low = np.minimum.reduceat((token ^ _FLIP[j]) * _TIMES[j], begin)
                        key = mix(key * U(0x2545F4914F6CDD1D) + low.astype(U))
                    keys[:, band] = key
            if prefix:  # a set's shingles are in the order of their hashes
                keys = h[np.arange(int(many.sum())) + np.repeat(bounds[:-1] - (np.cumsum(many) - many), many)]
            ends = np.zeros(len(n) + 1, np.int32)
            ends[1:] = np.cumsum(many)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            ids = batch.column("did").slice(words.rows.start, len(n))
            yield pa.record_batch(
                [ids, pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), bands], names=["did", "n", "s1", "s2", "bands"]
            )


class Tree:
    """A signature tree over sets ordered by size, with a dual traversal of itself."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        order = np.lexsort((np.arange(len(sets)), [len(s) for s in sets]))
        self.order, self.percent = order, percent
        self.sets = [sets[i] for i in order]
        self.label = labels[order].copy()
        self.sizes = np.array([len(s) for s in self.sets])
        bits = 256
        while bits < 2 * int(self.sizes.max()) and bits < 1 << 14:
            bits *= 2
        maps = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(self.sets):
            maps[i, (s % U(bits)).astype(np.int64)] = True
        self.maps = np.packbits(maps, axis=1).view(U)
        self.slack = self.sizes - maps.sum(axis=1)  # tokens beyond one per bit
        # Levels from the leaves up: (first, last) of each node's sets, OR of bitmaps, largest slack.
        cuts = np.arange(0, len(sets), LEAF)
        level = (cuts, np.minimum(cuts + LEAF, len(sets)), np.bitwise_or.reduceat(self.maps, cuts, axis=0), np.maximum.reduceat(self.slack, cuts))
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), LEAF)
            level = (level[0][cuts], level[1][np.minimum(cuts + LEAF, len(level[0])) - 1], np.bitwise_or.reduceat(level[2], cuts, axis=0), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)
        self.links: list[tuple[int, int]] = []

    def links_found(self) -> list[tuple[int, int]]:
        """A forest of verified links that connects all that the pairs of sets connect."""
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if not self._possible(level, a, b):
                continue
            if not level:
                self._leaves(a, b)
                continue
            below = len(self.levels[level - 1][0])
            left = range(a * LEAF, min((a + 1) * LEAF, below))
            right = range(b * LEAF, min((b + 1) * LEAF, below))
            pairs = [(x, y) for x in left for y in right if x <= y] if a == b else [(x, y) for x in left for y in right]
            pairs.sort(key=lambda p: p[0] - p[1])  # the stack takes a node with itself first
            stack += [(level - 1, x, y) for x, y in pairs]
        return [(int(self.order[x]), int(self.order[y])) for x, y in self.links]

    def _possible(self, level: int, a: int, b: int) -> bool:
        first, last, maps, slack = self.levels[level]
        least, most = self.sizes[first[max(a, b)]], self.sizes[last[min(a, b)] - 1]
        if a != b and most * 100 < least * self.percent:
            return False
        own, other = self.label[first[a] : last[a]], self.label[first[b] : last[b]]
        if own[0] == other[0] and (own == own[0]).all() and (other == own[0]).all():
            return False
        if a == b:
            return True
        overlap = int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(int(slack[a]), int(slack[b]))
        return overlap * 100 >= least * self.percent

    def _leaves(self, a: int, b: int) -> None:
        first, last = self.levels[0][:2]
        i, j = np.arange(first[a], last[a]), np.arange(first[b], last[b])
        shared = np.bitwise_count(self.maps[i][:, None, :] & self.maps[j][None, :, :]).sum(axis=2)
        most = np.minimum(shared + np.minimum(self.slack[i][:, None], self.slack[j][None, :]), np.minimum(self.sizes[i][:, None], self.sizes[j][None, :]))
        total = self.sizes[i][:, None] + self.sizes[j][None, :]
        able = most * 100 >= self.percent * (total - most)
        if a == b:
            able &= i[:, None] < j[None, :]
        for x, y in np.argwhere(able & (self.label[i][:, None] != self.label[j][None, :])):
            p, q = int(i[x]), int(j[y])
            if self.label[p] == self.label[q]:
                continue  # connected meanwhile
            common = int(np.isin(self.sets[p], self.sets[q], assume_unique=True).sum())
            if common * 100 >= self.percent * (int(self.sizes[p]) + int(self.sizes[q]) - common):
                self.links.append((p, q))
                self.label[self.label == self.label[q]] = self.label[p]


def _tree_links(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each tree; the rows of a tree (equal ``key``, ``part``) are adjacent."""
    expand = zstandard.ZstdDecompressor()
    held: list[tuple] = []
    current = None

    def close() -> list[tuple[int, int]]:
        ids = [r[0] for r in held]
        if len(held) < 2:
            return []
        sets: list[np.ndarray] = []
        for words in slices(pa.array([expand.decompress(r[2]).decode() for r in held], pa.large_string()), lower=True):
            h, bounds = shingle_sets(words, size)
            sets += [h[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        _, labels = np.unique(np.array([r[1] for r in held]), return_inverse=True)
        return [(ids[x], ids[y]) for x, y in Tree(sets, labels, percent).links_found()]

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    for batch in small(batches):
        links = []
        for key, part, did, label, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "did", "label", "packed")), strict=True):
            if (key, part) != current:
                links += close()
                held, current = [], (key, part)
            held.append((did, label, packed))
        yield out(links)
    yield out(close())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in small(batches):
        packed = [squeeze.compress((text.as_py() or "").encode()) for text in batch.column("text")]
        yield pa.record_batch([batch.column("did"), pa.array(packed, pa.binary())], names=["did", "packed"])


def _links(rows: DataFrame, pool: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` from trees given as ``(key, part, did, label)``."""
    rows = rows.join(pool, "did").select("key", "part", "did", "label", "packed")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "did").mapInArrow(lambda it: _tree_links(it, size, percent), "a long, b long")


def _alone(members: DataFrame) -> DataFrame:
    """Trees of ``(key, did, crowd)`` in blocks of about CROWD sets, each alone: enough to connect most of a large group."""
    block = F.pmod(F.xxhash64("did", "key"), F.ceil(F.col("crowd") / CROWD))
    return members.select("key", block.cast("long").alias("part"), "did", F.col("did").alias("label"))


def _crossed(members: DataFrame) -> DataFrame:
    """Trees of ``(key, did, label)`` in blocks of about CROWD sets, each with every other it may have a new link to.

    The sets of a label that fills blocks have blocks of their own, which never meet one another:
    sets of one label are connected already. So a large component meets the strangers among it
    and nothing else, and a tree whose sets have all one label is left out.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    large = F.when(F.col("n") >= CROWD, F.struct("label", F.ceil(F.col("n") / CROWD).cast("long").alias("n")))
    keys = sizes.groupBy("key").agg(
        F.count("*").alias("labels"), F.ceil(F.sum(F.when(F.col("n") < CROWD, F.col("n")).otherwise(0)) / CROWD).alias("mixed"), F.sort_array(F.collect_list(large)).alias("large")
    )
    keys = keys.where("labels > 1").withColumn("firsts", barrier(before(F.transform("large", lambda x: x["n"]))))
    blocks = F.col("mixed") + F.aggregate("large", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    own = F.filter(F.arrays_zip("large", "firsts"), lambda x: x["large"]["label"] == F.col("label"))
    rows = members.join(keys.withColumn("blocks", blocks), "key").withColumn("own", F.get(own, 0))
    first, count = F.col("mixed") + F.col("own.firsts"), F.col("own.large.n")
    block = F.pmod(F.xxhash64("did", "key"), F.coalesce(count, F.col("mixed"))) + F.coalesce(first, F.lit(0))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.col("own").isNull() | (o < first) | (o >= first + count))
    rows = rows.withColumn("block", block)
    parts = F.transform(others, lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    return rows.select("key", F.explode(parts).alias("part"), "did", "label")


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)``: the least node that each node of ``links(a, b)`` is connected to.

    Every round each component joins its least neighbour, two hops at a time, until no link
    crosses. A round's tables are written, in as many files as they need, which cuts the lineage.
    """
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
    spark = links.sparkSession
    both = hold(links.select(F.inline(F.array(way("a", "b"), way("b", "a")))).distinct())
    files = 1 + both.count() // FILE_ROWS
    both, held_both = materialise(both.coalesce(files), "links"), both
    held_both.unpersist()
    labels, old = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")), []
    while True:
        labels = materialise(labels.coalesce(files), "labels")
        there = labels.select(F.col("node").alias("other"), F.col("comp").alias("beyond"))
        crossing = both.join(labels, "node").join(there, "other").where("comp > beyond")
        moves = materialise(crossing.groupBy("comp").agg(F.min("beyond").alias("to")).coalesce(files), "moves")
        for path in old:
            discard(spark, path)
        old = [labels.stored, moves.stored]
        if moves.isEmpty():
            discard(spark, moves.stored)
            discard(spark, both.stored)
            return labels
        onward = moves.select(F.col("comp").alias("to"), F.col("to").alias("on"))
        hops = moves.join(onward, "to", "left").select("comp", F.coalesce("on", "to").alias("to"))
        labels = labels.join(hops, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def _split(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on ``on`` whose sides are both exchanged for it, so that a hot key is split at run time."""
    fresh = F.xxhash64(*on).alias("fresh")
    return left.select("*", fresh).join(right.select("*", fresh), ["fresh", *on], how).drop("fresh")


def _sifted(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose ``did`` isn't among the needed ones, so that fewer texts are exchanged.

    A blocked Bloom filter, broadcast where its size, known here, allows it; else all rows.
    """
    blocks = max(64, needed.count() // LOAD)
    if blocks > MAX_BLOCKS:
        return docs
    words = needed.groupBy(_block(F.col("did"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("did"))).alias("word"))
    possible = docs.withColumns({"block": _block(F.col("did"), blocks), "mask": _mask(F.col("did"))}).join(F.broadcast(words), "block")
    return possible.where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("did", "text")


def jaccard_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles and component_id.

    component_id is the smallest doc_id that links of at least ``percent`` hundredths reach, the
    document itself included. Null and blank texts have no shingles and are linked with nothing; a
    text of fewer than ``size`` words is one shingle. Rows with one doc_id are one document of
    several texts. A row without a doc_id is linked with nothing and its component_id is null. The
    doc_id is a whole number or a string of digits. Other columns are ignored; an empty table
    gives an empty one.

    With ``exact`` sets meet where they share one of the shingles of least hash that any two so
    alike must share, instead of by bands: nothing is missed, at the cost of larger trees.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("did"), "text")
    sketch = hold(docs.mapInArrow(lambda it: _sketch_rows(it, size, percent if exact else 0), SKETCH_ROW))
    linked = sketch.where("n > 0 and did is not null")
    classes = hold(linked.groupBy("s1", "s2").agg(F.min("did").alias("rep"), F.first("bands").alias("bands")))

    dealt = classes.select(F.col("rep").alias("did"), F.posexplode("bands").alias("band", "key")).select("key", "did", (F.col("band") < EARLY).alias("early"))
    crowds = dealt.groupBy("key").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.count("*").alias("crowd")).where("lo < hi")
    members = hold(dealt.join(crowds.select("key", "crowd"), "key"))
    needed = hold(members.select("did").distinct())
    pool = hold(_sifted(docs.where("did is not null"), needed).mapInArrow(_pack, "did long, packed binary").join(needed, "did", "left_semi"))

    # Rows of one doc_id in several classes tie those together.
    reps = _split(linked.select("did", "n", "s1", "s2"), classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("did", "n", "rep")
    least = reps.groupBy("did").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a < top")
    ties = reps.join(least, "did").where("rep > a").select("a", F.col("rep").alias("b")).distinct()

    files = 1 + members.count() // FILE_ROWS
    first = _links(_alone(members.where("early")), pool, size, percent).unionByName(ties)
    first = materialise(first.repartition(files), "first")
    labels = components(first)
    known = members.join(labels.withColumnRenamed("node", "did"), "did", "left").withColumn("label", F.coalesce("comp", "did"))
    # A tree in one block has been traversed whole.
    second = _links(_crossed(known.where(f"not early or crowd > {CROWD}").select("key", "did", "label")), pool, size, percent)
    final = components(first.unionByName(second)).withColumnRenamed("node", "rep")
    for table_ in (members, needed, pool):
        table_.unpersist()
    for path in (first.stored, labels.stored):
        discard(docs.sparkSession, path)

    out = _split(reps, final, ["rep"], "left").select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    rest = sketch.where("n = 0 or did is null").select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("did").alias("component_id"))
    return out.unionByName(rest)


def keep_firsts(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the rows whose doc_id is their component's least.

    Rows with one doc_id are one document of several texts, which all stay or all go; of rows that
    have doc_id and text in common one stays, the least by all columns. Rows without a doc_id all
    stay. All columns are kept. The texts go through one exchange; those with repeated ids through another.
    """
    classes = jaccard_classes(docs.select("doc_id", "text"), size, percent)
    ids = hold(classes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("later"), F.count("*").alias("n")))
    ids = ids.where("later or n > 1").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    unnamed = docs.where(F.col("doc_id").isNull())
    kept = docs.where(F.col("doc_id").isNotNull()).join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(unnamed)
    repeated = ids.where("not later").select("doc_id")
    if repeated.isEmpty():
        return kept
    several = docs.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    one = several.groupBy(F.col("row.doc_id").alias("d"), F.md5(F.col("row.text").cast("binary")).alias("t")).agg(F.min("row").alias("row"))
    return kept.unionByName(one.select(*[F.col("row").getField(x).alias(x) for x in docs.columns]))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) >= 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach(doc_id, comp) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT links.b, reach.comp FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.comp < links.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(comp) AS comp FROM reach GROUP BY doc_id) c USING (doc_id)
"""
QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES = {"op7_jaccard_join": OP7_SQL}
