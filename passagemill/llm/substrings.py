"""Substring dedup by recompression.

A text is a sequence of word names. Rounds name it anew. A run of equal symbols becomes one symbol,
named after the symbol and its length; then a symbol is on the left or right side by a bit of its
name, and a left one followed by a right one become one symbol, named after both. A name is a hash
of what it stands for, so all tasks give a run or a pair the same name without asking, and equal
substrings have the same symbols but near their ends. A round shortens a text by a quarter about.

1. High symbols: after each of LEVELS rounds, the symbols of at least a window's length go through
   one exchange, with a second hash of their words that verifies them. A symbol that an earlier
   document has is a repeat as long as it is: its words go, and no window in it is looked at again.
   A long copy travels as some dozens of symbols.
2. What is left, mostly the repeats' ends and what is shorter than a symbol, is worked by windows.
   After two rounds of pairs alone a symbol spans at most four words, and every window of 13 words
   holds a whole symbol that is the same in all its occurrences; the one with the least name is the
   window's anchor. (After ``r`` rounds of pairs all but ``2**r - 1`` words at either end of a window
   are parsed alike, so a window of ``4 * 2**r - 3`` words has one.) Anchors, named with the words
   around them that all their windows share, go through an exchange; one seen in one document only
   can't be part of a repeat, and most of a corpus ends here. Windows of the others are named with
   96 bits in full, which verifies them, and go through another that finds each one's first document.
3. A document's removed symbols and windows come back to it as word positions.

What repeats within a batch is combined there before each exchange, so a passage that a third of
all documents share sends a row per batch. Texts travel packed, through one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table
from .tokens import U, Words, grams, mix, slices, small, spans

WINDOW = 13
#: Rounds after which symbols are compared: of about 60 and 300 words.
LEVELS = (14, 20)
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def rounds_for(window: int) -> int:
    """The most rounds after which each window still holds a whole symbol."""
    r = 0
    while window >= 4 * 2 ** (r + 1) - 3:
        r += 1
    return r


def parse(words: Words, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first word and length of each symbol after so many rounds."""
    name, doc = words.hash.copy(), words.doc()
    start = np.arange(len(name))
    for r in range(rounds):
        left = (mix(name + U(r + 1)) & U(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * U(0x9FB21C651E98DF25) + name[at + 1] + U(r + 1))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start, doc = name[keep], start[keep], doc[keep]
    end = np.append(start[1:], len(words.hash))
    last = words.bounds[1:][doc]
    return name, start, np.minimum(end, last) - start


def high_symbols(words: Words, levels: tuple[int, ...], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first word and length of the symbols of at least so many words, after each of the rounds listed."""
    name, doc, start = words.hash.copy(), words.doc(), np.arange(len(words.hash))
    last = words.bounds[1:]
    found: list[tuple[np.ndarray, ...]] = []
    for r in range(1, max(levels) + 1):
        # Runs of one symbol become one, named after it and how many they are.
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(name))).astype(U)
        name, doc, start = name[at], doc[at], start[at]
        name = np.where(many > 1, mix(name * U(0xD1342543DE82EF95) + many + U(r << 32)), name)
        # A left symbol and the right one after it become one.
        left = (mix(name + U(r)) & U(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * U(0x9FB21C651E98DF25) + name[at + 1] + U(r))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, doc, start = name[keep], doc[keep], start[keep]
        if r in levels:
            length = np.minimum(np.append(start[1:], len(words.hash)), last[doc]) - start
            long = length >= least
            found.append((name[long], start[long], length[long]))
    name, start, length = (np.concatenate(x) for x in zip(*found))
    _, once = np.unique(start * (len(words.hash) + 1) + length, return_index=True)  # one that no later round changed
    return name[once], start[once], length[once]


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, the anchor of each, and each anchor's key."""
    rounds = rounds_for(window)
    margin = 2**rounds - 1
    n = len(words.hash)
    _, at = grams(words.hash, words.bounds, window)
    if not len(at):
        return at, at, np.zeros(0, U)
    name, start, length = parse(words, rounds)
    names = np.full(n, ~U(0))
    lengths = np.full(n, window, np.int64)
    names[start], lengths[start] = name, length
    best, where = np.full(len(at), ~U(0)), np.full(len(at), -1)
    for o in range(margin, window - margin):
        s = at + o
        better = (o + lengths[s] <= window - margin) & ((names[s] < best) | (where < 0))
        best = np.where(better, names[s], best)
        where = np.where(better, s, where)
    # Every window of an anchor holds it and ``margin`` words on both sides: they make its key.
    used, of = np.unique(where, return_inverse=True)
    key = np.zeros(len(used), U)
    span = lengths[used] + 2 * margin
    for i in range(int(span.max())):
        inside = i < span
        word = words.hash[np.minimum(used - margin + i, n - 1)]
        key = np.where(inside, mix(key * U(0x2545F4914F6CDD1D) + word), key)
    return at, of, mix(key + span.astype(U))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("did").to_numpy(zero_copy_only=False)


def _first_of(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document, whether an entry is its key's first, and the group number."""
    order = np.lexsort((docs, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new, np.cumsum(new) - 1


SYMBOL_ROW = "h1 long, h2 int, did long, spot long, span int, known boolean"


def _spots(words: Words, tags: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words are: their row's tag, which tells rows of one doc_id apart, and their place in its text."""
    return (tags[words.rows].astype(np.int64)[doc] << 32) | (at - words.bounds[doc])


def _symbol_rows(batches: Iterator[pa.RecordBatch], window: int, levels: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """High symbols of all documents; ``known`` where the batch holds an earlier document with one."""
    for batch in small(batches, 4096, "text"):
        ids, tags = _ids(batch), batch.column("tag").to_numpy()
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for words in slices(batch.column("text")):
            name, start, length = high_symbols(words, levels, window)
            own = words.doc()[start]
            for part, value in zip(parts, (name, spans(words.hash, start, length) >> U(32), ids[words.rows][own], _spots(words, tags, own, start), length), strict=True):
                part.append(value)
        if not parts[0]:
            continue
        h1, h2, doc, spot, length = (np.concatenate(p) for p in parts)
        order, new, group = _first_of([h1, h2], doc)
        h1, h2, doc, spot, length = h1[order], h2[order], doc[order], spot[order], length[order]
        known = doc > doc[new][group]
        yield pa.record_batch(
            [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(spot), pa.array(length.astype(np.int32)), pa.array(known)],
            names=["h1", "h2", "did", "spot", "span", "known"],
        )


def _open_windows(words: Words, at: np.ndarray, batch: pa.RecordBatch, tags: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that start at the words ``at`` lie in no single symbol that is a repeat."""
    inside = np.zeros(len(words.hash) + 1, np.int64)
    for row, cover in enumerate(batch.column("cover").slice(words.rows.start, len(words.bounds) - 1)):
        if cover.is_valid:
            spot, span = (np.asarray(cover.values.field(k)) for k in ("spot", "span"))
            mine = spot >> 32 == tags[words.rows][row]
            first = (spot[mine] & 0xFFFFFFFF) + words.bounds[row]
            np.add.at(inside, first, 1)
            np.add.at(inside, first + span[mine] - window + 1, -1)
    return np.cumsum(inside)[at] == 0


ANCHOR_ROW = "key long, did long, known boolean"


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each document's anchor keys of open windows: ``known`` where the batch shows a second document."""
    for batch in small(batches, 4096, "packed", 1 << 23):
        ids, tags, keys, docs = _ids(batch), batch.column("tag").to_numpy(), [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for words in slices(_unpacked(batch.column("packed"))):
            at, of, key = anchors(words, window)
            wanted = _open_windows(words, at, batch, tags, window)
            at, of = at[wanted], of[wanted]
            if len(at):
                own = words.doc()[at]
                first = np.ones(len(at), bool)
                first[1:] = (of[1:] != of[:-1]) | (own[1:] != own[:-1])
                keys.append(key[of[first]])
                docs.append(ids[words.rows][own[first]])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        if not len(key):
            continue
        order, new, group = _first_of([key], doc)
        key, doc = key[order], doc[order]
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]  # one entry per key and document
        key, doc, new, group = key[fresh], doc[fresh], new[fresh], group[fresh]
        known = np.bincount(group)[group] > 1
        # A key's first document speaks for the batch; the others' rows need no answer.
        yield pa.record_batch(
            [pa.array(np.r_[key[new], key[known]].view(np.int64)), pa.array(np.r_[doc[new], doc[known]]), pa.array(np.r_[np.zeros(new.sum(), bool), np.ones(known.sum(), bool)])],
            names=["key", "did", "known"],
        )


PACKED_ROW = "did long, tag int, digest string, packed binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in small(batches, 1024, "text"):
        packed = [squeeze.compress((text.as_py() or "").encode()) for text in batch.column("text")]
        yield pa.record_batch([batch.column("did"), batch.column("tag"), batch.column("digest"), pa.array(packed, pa.binary())], names=["did", "tag", "digest", "packed"])


def _unpacked(column: pa.Array) -> pa.Array:
    expand = zstandard.ZstdDecompressor()
    return pa.array([expand.decompress(x.as_py()).decode() for x in column], pa.large_string())


WINDOW_ROW = "h1 long, h2 int, did long, spot long, known boolean"


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Full names of the windows of candidate anchors; ``known`` where the batch holds an earlier document."""
    for batch in small(batches, 2048, "packed", 1 << 23):
        ids, tags = _ids(batch), batch.column("tag").to_numpy()
        wanted = batch.column("keys")
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        for words in slices(_unpacked(batch.column("packed"))):
            at, of, key = anchors(words, window)
            if not len(at):
                continue
            own = words.doc()[at]
            listed = wanted.slice(words.rows.start, words.rows.stop - words.rows.start)
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            # A key counts for the row that asks for it: row and key as one value on both sides.
            asked = mix(listed.flatten().to_numpy().view(U) ^ mix(row.astype(U) + U(1)))
            hit = np.isin(mix(key[of] ^ mix(own.astype(U) + U(1))), asked) & _open_windows(words, at, batch, tags, window)
            h1, _ = grams(words.hash, words.bounds, window)
            h2, _ = grams(mix(words.hash + U(7)), words.bounds, window, 7)
            spot = _spots(words, tags, own, at)
            for part, value in zip(parts, (h1[hit], (h2[hit] >> U(32)), ids[words.rows][own[hit]], spot[hit]), strict=True):
                part.append(value)
        if not parts[0]:
            continue
        h1, h2, doc, spot = (np.concatenate(p) for p in parts)
        order, new, group = _first_of([h1, h2], doc)
        h1, h2, doc, spot = h1[order], h2[order], doc[order], spot[order]
        known = doc > doc[new][group]
        yield pa.record_batch(
            [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(spot), pa.array(known)],
            names=["h1", "h2", "did", "spot", "known"],
        )


OUT_ROW = "doc_id long, n_words long, n_removed long, kept_text string"


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in small(batches, 1024, "packed", 1 << 23):
        out = []
        for doc, tag, packed, copy, cover, gone in zip(*(batch.column(c) for c in ("did", "tag", "packed", "copy", "cover", "gone")), strict=True):
            words = expand.decompress(packed.as_py()).split()
            n = len(words)
            if copy.as_py() and n >= window:
                words = []
            elif gone.is_valid or cover.is_valid:
                edge = np.zeros(n + 1, np.int64)
                for spot, span in [
                    (np.asarray(gone.values), window) if gone.is_valid else (np.zeros(0, np.int64), window),
                    tuple(np.asarray(cover.values.field(k)) for k in ("spot", "span")) if cover.is_valid else (np.zeros(0, np.int64), window),
                ]:
                    mine = spot >> 32 == tag.as_py()
                    first = spot[mine] & 0xFFFFFFFF
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.minimum(first + (span if np.isscalar(span) else span[mine]), n), -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            out.append((None if doc.as_py() == LAST else doc.as_py(), n, n - len(words), b" ".join(words).decode()))
        doc, n, removed, kept = zip(*out) if out else ((), (), (), ())
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Every text without the words covered by a window that also starts in an earlier document.

    ``docs`` needs text and doc_id, a whole number or a string of digits; other columns are ignored.
    Words are ``[^\\x20\\x09-\\x0D]+``. Earlier means a smaller doc_id; a null doc_id comes last. Rows
    with one doc_id never remove from each other. Null, empty and short texts are kept as they are;
    an empty table gives an empty one.

    Returns doc_id, n_words, n_removed, kept_text (the kept words, joined by one space).
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.select("did", F.hash("text").alias("tag"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    # Rows that need no answer are spread by document instead of meeting under their key.
    spread = F.when(F.col("known"), F.col("did")).otherwise(F.lit(-1)).alias("spread")

    # 1. High symbols that an earlier document has.
    symbols = named.select("did", "tag", "text").mapInArrow(lambda it: _symbol_rows(it, window, levels), SYMBOL_ROW)
    earliest = F.min("did").over(Window.partitionBy("h1", "h2", "spread"))
    repeats = symbols.select("h1", "h2", spread, "did", "spot", "span", "known").withColumn("first", earliest).where("known or did > first")
    cover = repeats.groupBy("did").agg(F.collect_list(F.struct("spot", "span")).alias("cover"))  # at most a document's symbols

    # Whole copies need no windows: the first document of a class speaks for it.
    classes = named.where("text != ''").select("did", "digest")
    firsts = classes.groupBy("digest").agg(F.min("did").alias("first"))
    copies = classes.join(firsts, "digest").where("did > first").groupBy("did").agg(F.collect_set("digest").alias("copied"))
    # Everything by document joins on it alone, so the texts go through one exchange, used three times.
    # (The filter drops nothing; an inner join adds it, and only equal exchanges are shared.)
    packed = named.mapInArrow(_pack, PACKED_ROW).where("did is not null").join(copies, "did", "left").join(cover, "did", "left")
    copy = F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False))
    packed = packed.select("did", "tag", "packed", copy.alias("copy"), "cover")

    # 2. Windows of anchors that two documents have.
    own = packed.where("not copy")
    found = own.select("did", "tag", "packed", "cover").mapInArrow(lambda it: _anchor_rows(it, window), ANCHOR_ROW)
    by_key = Window.partitionBy("key", "spread")
    met = found.select("key", spread, "did", "known").withColumns({"lo": F.min("did").over(by_key), "hi": F.max("did").over(by_key)}).where("known or lo < hi")
    asked = met.groupBy("did").agg(F.collect_set("key").alias("keys"))  # at most a document's words
    windows = own.join(asked, "did").select("did", "tag", "packed", "cover", "keys").mapInArrow(lambda it: _window_rows(it, window), WINDOW_ROW)
    gone = windows.select("h1", "h2", spread, "did", "spot", "known").withColumn("first", earliest).where("known or did > first")

    # 3. Back to the documents.
    spots = gone.groupBy("did").agg(F.collect_list("spot").alias("gone"))
    return packed.join(spots, "did", "left").mapInArrow(lambda it: _removed(it, window), OUT_ROW)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`drop_repeats` over the whole of ``documents``."""
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS lo FROM g) WHERE doc_id > lo),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
pos AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt, count(*) AS n
  FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
QUERIES = {"op8_substrings": op8_substrings}
ORACLES = {"op8_substrings": OP8_SQL}
