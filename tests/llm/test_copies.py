"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import random
import re

import corpus
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from passagemill.llm import jaccard_join, substrings
from passagemill.llm.tokens import grams, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_texts(rows, window):
    """doc_id -> the kept words of each of its rows."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    words = [WORD.findall(t or "") for _, t, *_ in order]
    for (i, *_), w in zip(order, words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for (i, *_), w in zip(order, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window", [13, 5])
def test_repeats(spark, seed, window):
    rows = corpus.documents(seed)
    got = substrings.drop_repeats(corpus.frame(spark, rows), window).collect()
    assert sorted((tuple(r) for r in got), key=repr) == kept_texts(rows, window)


def test_repeats_of_small_alphabets(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 80))), "", "", 0) for i in range(40)]
    rows += [(40, "run " * 60, "", "", 0), (41, "x " + "run " * 30, "", "", 0), (42, None, "", "", 0), (None, "run " * 20, "", "", 0), (41, "other text of this id", "", "", 0)]
    got = substrings.drop_repeats(corpus.frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == kept_texts(rows, 13)


@pytest.mark.parametrize("levels", [(5, 9), (6, 8, 14), substrings.LEVELS])
def test_long_repeats(spark, levels):
    """Documents glued of passages from a pool, so that repeats begin, end and meet anywhere, some of runs of one word."""
    r = random.Random(len(levels) + levels[0])
    pool = [corpus.passage(r, r.choice([14, 40, 150, 600]), 3000) for _ in range(25)] + ["run " * 90, "a b " * 70]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choice(pool).split()[r.randrange(8) :]) if r.random() < 0.8 else corpus.passage(r, r.randint(1, 40), 3000) for _ in range(r.randint(1, 7))]
        rows.append((i, r.choice([" ", "\n"]).join(parts), "", "", 0))
    rows += [(7, rows[40][1], "", "", 0), (None, rows[3][1] + " x", "", "", 0)]
    got = substrings.drop_repeats(corpus.frame(spark, rows), levels=levels).collect()
    assert sorted((tuple(x) for x in got), key=repr) == kept_texts(rows, 13)


def test_a_long_copy_travels_as_a_few_symbols():
    """Of 5,000 words in other surroundings, all but the ends are symbols of both, less than a hundred of them."""
    r = random.Random(2)
    body = corpus.passage(r, 5000, 100_000)
    one, two = (corpus.passage(r, n, 100_000) + " " + body + " " + corpus.passage(r, n, 100_000) for n in (300, 411))
    batch = pa.record_batch({"did": pa.array([1, 2]), "tag": pa.array([5, 6], pa.int32()), "text": [one, two]})
    rows = [x for b in substrings._symbol_rows(iter([batch]), 13, substrings.LEVELS) for x in b.to_pylist()]
    shared = [x for x in rows if x["known"]]
    covered = {p for x in shared for p in range(x["spot"] & 0xFFFFFFFF, (x["spot"] & 0xFFFFFFFF) + x["span"])}
    assert {x["did"] for x in shared} == {2} and len([x for x in rows if x["did"] == 2]) < 135 and len(shared) < 115
    assert len(covered) > 4500 and min(covered) >= 411 and max(covered) < 5411
    cover = [[], [{"spot": x["spot"], "span": x["span"]} for x in shared]]
    packed = pa.record_batch({**{c: batch.column(c) for c in ("did", "tag")}, "packed": [zstandard.compress(t.encode()) for t in (one, two)], "cover": pa.array(cover, pa.list_(pa.struct({"spot": pa.int64(), "span": pa.int32()})))})
    keys = [x for b in substrings._anchor_rows(iter([packed]), 13) for x in b.to_pylist()]
    both = [x for x in keys if x["known"] and x["did"] == 2]
    assert len(both) < 350  # anchors of the ends, and of windows across two symbols


def test_runs_are_one_symbol():
    """A run is named after its word and length, whatever stands around it; so is what pairs are made of it."""
    (words,) = slices(pa.array(["x " * 1000 + "y", "z " + "x " * 1000, "x " * 999]))
    name, start, length = substrings.high_symbols(words, (1,), 13)
    at = dict(zip(start.tolist(), zip(name.tolist(), length.tolist())))
    assert sorted(n for _, n in at.values()) in ([999, 1000, 1000], [999, 1000, 1001], [999, 1001, 1001]) and len(at) == 3
    name, start, length = substrings.high_symbols(words, substrings.LEVELS, 13)
    assert len(name) <= 6


def test_no_documents(spark, nothing):
    assert substrings.drop_repeats(nothing).count() == 0
    assert jaccard_join.jaccard_classes(nothing).count() == 0 and jaccard_join.keep_firsts(nothing).count() == 0


def test_every_window_has_a_common_anchor():
    """Equal windows agree on their anchor's place and key, whatever stands around them."""
    r = random.Random(3)
    for window in (5, 13, 29, 40):
        body = [r.choice("abcdefgh") for _ in range(window)]
        seen = set()
        for _ in range(30):
            text = " ".join([r.choice("abcdefgh") for _ in range(r.randint(0, 20))] + ["|"] * 0 + body + [r.choice("abcdefgh") for _ in range(20)])
            lead = len(text.split()) - len(body) - 20
            (words,) = slices(pa.array([text]))
            at, of, key = substrings.anchors(words, window)
            k = int(np.flatnonzero(at == lead)[0])
            seen.add(int(key[of[k]]))
        assert len(seen) == 1


def shingles(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def classes(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for x in ids:
            for y in ids:
                if x < y and comp[x] != comp[y] and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    low, high = sorted((comp[x], comp[y]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_similarity_classes(spark, seed):
    rows = corpus.documents(seed, 90)
    want = classes(rows)
    got = jaccard_join.jaccard_classes(corpus.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    kept = jaccard_join.keep_firsts(corpus.frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert "rank" in kept.columns and kept.columns == corpus.frame(spark, rows).columns


@pytest.mark.parametrize("seed", range(2))
def test_exact_mode(spark, seed):
    rows = corpus.documents(seed, 90)
    got = jaccard_join.jaccard_classes(corpus.frame(spark, rows), exact=True).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(rows)


def test_documents_without_an_id(spark):
    """They tie nothing together, and stay."""
    x, y = near_copies(1, 5, 0)[0], near_copies(1, 6, 0)[0]
    rows = [(1, x, "", "", 0), (2, y, "", "", 0), (None, x, "", "", 0), (None, y, "", "", 0), (None, y, "", "", 0), (None, None, "", "", 0), (3, y, "", "", 0)]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_classes(corpus.frame(spark, rows)).collect()), key=repr)
    n, m = len(shingles(x)), len(shingles(y))
    assert got == sorted([(1, n, 1), (2, m, 2), (3, m, 2), (None, n, None), (None, m, None), (None, m, None), (None, 0, None)], key=repr)
    kept = jaccard_join.keep_firsts(corpus.frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, x), (2, y), (0, x), (0, y), (0, y), (0, "")])


def test_texts_of_one_id_all_stay(spark):
    x, y, z = (near_copies(1, k, 0)[0] for k in (5, 6, 7))
    rows = [(1, x, "b", "", 0), (1, y, "", "", 0), (1, x, "a", "", 0), (2, z, "", "", 0), (3, z, "", "", 0), (3, z, "", "", 0)]
    kept = jaccard_join.keep_firsts(corpus.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in kept) == sorted([(1, x, "a"), (1, y, ""), (2, z, "")])


def test_strangers_meet_a_large_component_alone(spark, monkeypatch):
    """Sets that are connected already don't meet again: rows sent follow the strangers, not the square of the crowd."""
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    rows = [(7, i, 0) for i in range(400)] + [(7, 1000, 1000), (7, 1001, 1001), (9, 1, 0), (9, 2, 0)]
    sent = jaccard_join._crossed(spark.createDataFrame(rows, "key long, did long, label long")).collect()
    met = {}
    for r in sent:
        met.setdefault((r["key"], r["part"]), set()).add(r["did"])
    assert {k for k, _ in met} == {7} and len(sent) <= 400 + 2 * 51
    pairs = {(min(a, b), max(a, b)) for m in met.values() for a in m for b in m if a != b}
    assert pairs >= {(i, s) for i in range(400) for s in (1000, 1001)} | {(1000, 1001)}


def near_copies(n, seed, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(300)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_groups_in_blocks(spark, monkeypatch):
    """Trees split in blocks lose nothing; a chain of links whose ends are not alike is one class."""
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    texts = near_copies(40, 2, 6) + near_copies(30, 9, 2)
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(corpus.frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_tree_finds_all_links():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 2**63, 60, dtype=np.uint64))
        for _ in range(r.integers(1, 25)):
            sets.append(np.unique(np.r_[r.choice(base, len(base) - r.integers(0, 12), replace=False), r.integers(0, 2**63, r.integers(0, 6), dtype=np.uint64)]))
    links = jaccard_join.Tree(sets, np.arange(len(sets)), 80).links_found()
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    assert all(alike(sets[x], sets[y]) for x, y in links)

    def components(pairs):
        comp = list(range(len(sets)))
        for x, y in pairs:
            low, high = sorted((comp[x], comp[y]))
            comp = [low if c == high else c for c in comp]
        return comp

    every = [(x, y) for x in range(len(sets)) for y in range(x) if alike(sets[x], sets[y])]
    assert components(links) == components(every) and len(links) < len(every)


def test_band_miss_is_negligible():
    assert (1 - 0.8**jaccard_join.ROWS) ** jaccard_join.BANDS < 2e-12


def test_components_of_chains(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    comp = {}
    for a, b in edges:
        comp.setdefault(a, a)
        comp.setdefault(b, b)
        low, high = sorted((comp[a], comp[b]))
        comp = {k: low if v == high else v for k, v in comp.items()}
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["comp"] for r in got.collect()} == comp


def test_words_and_grams():
    texts = [None, "", "a b  a\tb", " é\u2003x ", "A b"]
    (words,) = slices(pa.array(texts))
    assert np.diff(words.bounds).tolist() == [0, 0, 4, 1, 2]
    assert words.hash[0] == words.hash[2] and words.hash[1] == words.hash[3] == words.hash[6] != words.hash[5]
    (low,) = slices(pa.array(texts), lower=True)
    assert low.hash[5] == low.hash[0]
    h, at = grams(words.hash, words.bounds, 2)
    assert at.tolist() == [0, 1, 2, 5] and h[0] == h[2]
    long = ["x y " * 100_000, "z"]
    assert [len(w.hash) for w in slices(pa.array(long), size=1000)] == [200_000, 1]
    (parts,) = slices(pa.array(["x y " * 300_000 + "w" * 2_000_000 + " x"]))
    assert len(set(parts.hash.tolist())) == 3 and parts.hash[0] == parts.hash[-1]


def test_digest(spark):
    rows = corpus.documents(5)
    kept = substrings.drop_repeats(corpus.frame(spark, rows)).select("doc_id", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, _, _, t in kept_texts(rows, 13))
