"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. A passage's words, lower-cased and hashed to
signed buckets, and its measures (shares of kinds of characters, word lengths, repetition) are
encoded by a layer that is learned with the rest; gated attention weighs the encodings, and the
weighted sum is scored. Only documents carry labels, so the attention learns which passages
decide. Trained on a bounded sample of labelled rows, applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .tokens import U, Words, mix, slices

PASSAGE = 64
#: Labelled documents that the model is fitted on at most, and passages of one such document: of a
#: longer one those with the least hashes. Scores are of all passages.
MAX_TRAIN = 4000
MAX_TRAIN_PASSAGES = 64
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 24, 12, 150, 0.02, 1e-3, 5

#: Kinds of bytes: 0 others, 1 space, 2 line end, 3 a-z, 4 A-Z, 5 0-9, 6 junk symbols, 7 ! and ?, 8 other marks, 9 beyond ASCII.
KINDS = np.zeros(256, np.int64)
KINDS[[9, 11, 12, 13, 32]] = 1
KINDS[10] = 2
KINDS[33:127] = 8
KINDS[97:123], KINDS[65:91], KINDS[48:58] = 3, 4, 5
KINDS[[ord(c) for c in "#*$%&|<>"]] = 6
KINDS[[33, 63]] = 7
KINDS[128:] = 9
N_KINDS = 10
N_MEASURES = N_KINDS + 6
#: Buckets of hashed words.
BUCKETS = 256
N_FEATURES = N_MEASURES + BUCKETS


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice, and the document row of each; an empty text has one."""
    counts = np.diff(words.bounds)
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    doc = np.repeat(np.arange(len(counts)), per_doc)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    first = words.bounds[:-1][doc] + rank * PASSAGE
    size = np.clip(words.bounds[1:][doc] - first, 0, PASSAGE)
    starts = np.append(words.starts, len(words.data))
    begin = np.where(size > 0, starts[np.minimum(first, len(starts) - 1)], words.offsets[doc])
    after = first + PASSAGE
    end = np.where(after < words.bounds[1:][doc], starts[np.minimum(after, len(starts) - 1)], words.offsets[1:][doc])
    end = np.where(size > 0, end, begin)
    length = end - begin
    # Bytes between passages (white space before a text's first word) belong to none.
    which = np.repeat(np.arange(len(doc)), length)
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    kinds = np.bincount(which * N_KINDS + KINDS[words.data[at]], minlength=len(doc) * N_KINDS).reshape(-1, N_KINDS)
    of = np.repeat(np.arange(len(doc)), size)
    n = np.maximum(size, 1)
    h = words.hash
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    unique = np.bincount(of[order][new], minlength=len(doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    solid = kinds.sum(axis=1) - kinds[:, 1] - kinds[:, 2]
    x = np.empty((len(doc), N_FEATURES), np.float32)
    sign = 1.0 - 2.0 * ((h >> U(32)) & U(1)).astype(np.float64)
    bucket = of * BUCKETS + (h % U(BUCKETS)).astype(np.int64)
    x[:, N_MEASURES:] = np.bincount(bucket, sign, len(doc) * BUCKETS).reshape(-1, BUCKETS) / np.sqrt(n)[:, None]
    x[:, :N_KINDS] = kinds / np.maximum(length, 1)[:, None]
    x[:, N_KINDS] = np.log1p(size) / 4
    x[:, N_KINDS + 1] = solid / n / 10
    x[:, N_KINDS + 2] = unique / n
    x[:, N_KINDS + 3] = np.bincount(of, again, minlength=len(doc)) / n
    x[:, N_KINDS + 4] = kinds[:, 2] / n * 10
    x[:, N_KINDS + 5] = kinds[:, 6] / n
    return x, doc


@dataclass
class Model:
    """Weights of encoder, attention and score, and the features' mean and scale."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """All that a pass computes; ``x`` is scaled already."""
        p = self.parts
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["g"]
        top = np.full(bags, -np.inf, e.dtype)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, minlength=bags)[bag].astype(a.dtype)
        z = np.stack([np.bincount(bag, a * h[:, j], minlength=bags) for j in range(h.shape[1])], axis=1).astype(h.dtype)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -60, 60)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": score}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(self.mean.dtype)

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the bags, back through score, attention and encoder."""
        f, p = self.forward(x, bag, len(y)), self.parts
        dz_out = ((f["score"] - y) / len(y)).astype(x.dtype)
        grad = {"c": f["z"].T @ dz_out, "d": np.array([dz_out.sum()])}
        dz = dz_out[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, minlength=len(y))[bag].astype(x.dtype))
        grad["g"] = (f["t"] * f["s"]).T @ de
        dt, ds = de[:, None] * p["g"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["g"] * f["t"] * f["s"] * (1 - f["s"])
        grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        grad["w"], grad["b"] = x.T @ dh, dh.sum(axis=0)
        return grad


def start(kind: type = np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    parts = {"w": normal(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE), "g": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1)}
    return {k: v.astype(kind) for k, v in parts.items()}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> Model:
    """Fit by Adam on the whole sample; the same sample gives the same model."""
    parts = start()
    if not len(y):
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), {k: np.zeros_like(v) for k, v in parts.items()})
    scale = x.std(axis=0) + 1e-3
    # A word is one of hundreds: all buckets have one scale, so that rare ones don't stand out by noise.
    scale[N_MEASURES:] = max(float(scale[N_MEASURES:].mean()), 1e-3) * np.sqrt(BUCKETS / N_MEASURES)
    model = Model(x.mean(axis=0).astype(np.float32), scale.astype(np.float32), parts)
    x, y = model.scaled(x), y.astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in parts.items()}
    v = {k: np.zeros_like(w) for k, w in parts.items()}
    for step in range(1, EPOCHS + 1):
        grad = model.gradient(x, bag, y)
        for k, w in parts.items():
            g = grad[k] + DECAY * w
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    # Fitted fast, applied exactly: scores depend on no neighbour in a batch.
    wide = lambda x: x.astype(np.float64)
    return Model(wide(model.mean), wide(model.scale), {k: wide(w) for k, w in parts.items()})


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for words in slices(batch.column("text"), lower=True):
            x, doc = passages(words)
            for k, (at, n) in enumerate(zip(np.searchsorted(doc, np.arange(len(words.bounds) - 1)).tolist(), np.bincount(doc).tolist(), strict=True)):
                own = x[at : at + n]
                if n > MAX_TRAIN_PASSAGES:
                    # By a hash of place and words, whatever else is in the slice.
                    name = mix(np.arange(n, dtype=U) + (np.abs(own).sum(axis=1) * 1000).astype(U))
                    own = own[np.sort(np.argsort(name, kind="stable")[:MAX_TRAIN_PASSAGES])]
                rows.append(own.tobytes())
        yield pa.record_batch([batch.column("quality"), pa.array(rows, pa.binary())], names=["quality", "x"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from at most MAX_TRAIN labelled documents outside the held-out fold.

    The sample is the labelled ids with the least hashes, so a bounded number of rows is broadcast
    and no text is shuffled. Null labels are left out; of several, a document's least counts. Of a
    document of more than MAX_TRAIN_PASSAGES passages so many are taken, by hash; none is left out.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text").mapInArrow(_measured, "quality int, x binary")
    return fit_bags([(r["quality"], bytes(r["x"])) for r in rows.collect()])


def fit_bags(rows: list[tuple[int, bytes]]) -> Model:
    """The model of (quality, features) rows, whatever order the tasks end in."""
    got = sorted(rows)
    if not got:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x in got]
    return fit(np.concatenate(bags), np.repeat(np.arange(len(got)), [len(x) for x in bags]), np.array([float(q > 0) for q, _ in got]))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, weights = [np.zeros(0)], [np.zeros(0)]
        for words in slices(batch.column("text"), lower=True):
            x, doc = passages(words)
            f = model.forward(model.scaled(x), doc, len(words.bounds) - 1)
            scores.append(f["score"].astype(np.float64))
            top = np.zeros(len(words.bounds) - 1)
            np.maximum.at(top, doc, f["a"])
            weights.append(top)
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(scores)), pa.array(np.concatenate(weights))], names=["doc_id", "score", "top_weight"])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, score (0 to 1) and the largest attention weight.

    A null or empty text is one empty passage and gets a score as any other. Scores depend on the
    text alone; repeated rows get equal scores; doc_id is of any type, null too, and returned as it
    is; other columns are ignored.
    """
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("top_weight", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, model), shape)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "top_weight")


QUERIES = {"op4_quality_model": op4_quality_model}
ORACLES: dict[str, str] = {}
