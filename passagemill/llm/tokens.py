"""Words of many texts at once as 64-bit hashes, in numpy.

A batch is worked through in slices of a few megabytes of text, so memory does
not follow the batch size; a single longer text is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text in one slice.
SLICE = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _gaps(marks: bool) -> np.ndarray:
    """Which bytes part words: ASCII white space, and with ``marks`` all of ASCII but letters and digits."""
    gaps = np.zeros(256, bool)
    if marks:
        gaps[:128] = [not chr(c).isalnum() for c in range(128)]
    gaps[[9, 10, 11, 12, 13, 32]] = True
    return gaps


_GAPS = {marks: _gaps(marks) for marks in (False, True)}


@lru_cache(maxsize=4)
def _byte_codes(lower: bool, marks: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    codes[_GAPS[marks]] = 0
    if lower:
        codes[65:91] = codes[97:123]
    return codes


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, INVERSE, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of a slice of documents.

    ``hash``: one 64-bit value per word. ``bounds``: word index at which each document starts,
    and the end. ``starts``: byte position of each word in ``data``; ``rows``: the slice's rows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool, marks: bool = False):
        self.data, self.offsets, self.rows = data, offsets, rows
        solid = ~_GAPS[marks][data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        first[inner] = solid[inner]
        self.starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, offsets)
        if not len(self.starts):
            self.hash = np.zeros(0, U)
            return
        self.hash = np.empty(len(self.starts), U)
        codes = _byte_codes(lower, marks)
        at = 0
        while at < len(self.starts):  # a text longer than a slice goes by pieces, so the powers stay few
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.starts, begin + SLICE)))
            end = self.starts[to] if to < len(self.starts) else len(data)
            up, down = _powers(max(SLICE, 1 << int(end - begin - 1).bit_length()))
            inside = self.starts[at:to] - begin
            self.hash[at:to] = np.add.reduceat(codes[data[begin:end]] * up[: end - begin], inside) * down[inside]
            at = to
        self.hash = mix(self.hash)

    def doc(self) -> np.ndarray:
        """Row of each word, within the slice."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(texts: pa.Array, lower: bool = False, marks: bool = False, size: int = SLICE) -> Iterator[Words]:
    """The slices of a column of texts, in order; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        own = offsets[at : to + 1]
        yield Words(data[own[0] : own[-1]], own - own[0], slice(at, to), lower, marks)
        at = to


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024, column: str | None = None, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows, and bytes in a ``column``, which bounds what a worker holds.

    A longer value is a batch of its own. At the end it gives back what is free: workers live on
    between stages, one beside the other.
    """
    for batch in batches:
        ends = np.arange(1, len(batch) + 1)
        if column is not None and len(batch):
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < len(batch):
            to = min(at + rows, len(batch))
            if column is not None:
                before = ends[at - 1] if at else 0
                to = min(to, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def spans(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, any number of any length, from running sums: no run is walked."""
    out = np.zeros(len(start), U)
    if len(start):
        up, down = _powers(max(SLICE, 1 << int(len(h)).bit_length()))
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)) * up[: len(h)], out=sums[1:])
        out = mix((sums[start + length] - sums[start]) * down[start])
    return out


def grams(h: np.ndarray, bounds: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that lie in one document, and the word each starts at."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    size = len(h) - n + 1
    out = np.zeros(size, U)
    for i in range(n):
        out = out * U(0x2545F4914F6CDD1D) + h[i : i + size]
        out ^= out >> U(32)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(h))  # words from here to the document's end
    at = np.flatnonzero(left[:size] >= n)
    return mix(out[at] ^ U(seed)), at
