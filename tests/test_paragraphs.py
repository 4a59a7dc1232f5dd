"""Atomizing, splitting, sampling and planning against loops."""

import json
import random

from pyspark.sql import functions as F
from test_text import sentences

from passagemill.operators import paragraphs as P
from passagemill.operators import planner as G
from passagemill.schema import PARAGRAPHS

KINDS = ["paragraph", "paragraph", "paragraph", "code_block", "list", "blockquote"]


def documents(n=60, seed=4):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        doc = []
        for i in range(r.randint(0, 9)):
            kind = r.choice(KINDS)
            text = " ".join(" ".join(r.choice(["aa", "bb", "cc"]) for _ in range(r.randint(1, 6))) + r.choice(".!?") for _ in range(r.randint(0, 14)))
            doc.append((i, text or " ", kind, kind == "code_block", None, None, "s"))
        out.append(doc)
    return out


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), f"i int, p {PARAGRAPHS}")


def ordered(df, *columns):
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect(), key=lambda r: r["i"])]


def is_split(p):
    return p[2] == "paragraph" and not p[3]


def atomize(doc, gs, ms):
    if gs <= 0:
        return [(p[1], None) for p in doc]
    out = []
    for p in doc:
        ss = sentences(p[1])
        if not is_split(p):
            out.append((p[1], p[0]))
        elif p[1].strip():
            if len(ss) < max(ms, gs + 1):
                out.append((p[1].strip(), p[0]))
            else:
                groups = [ss[k : k + gs] for k in range(0, len(ss), gs)]
                if len(groups[-1]) < gs:
                    groups[-2:] = [groups[-2] + groups[-1]]
                out += [(" ".join(g), p[0]) for g in groups]
    return out


def estimate(counts, gs, ms):
    return sum(1 if c < max(ms, gs + 1) else max(1, c // gs) for c in counts)


def test_atomize_and_estimate(spark):
    docs = documents()
    df = frame(spark, docs)
    for gs, ms in [(0, 6), (1, 0), (2, 6), (3, 4), (4, 0)]:
        got = ordered(df, P.atomize(F.col("p"), F.lit(gs), F.lit(ms)).alias("a"), P.sentence_counts(F.col("p")).alias("n"))
        for doc, (atoms, counts) in zip(docs, got):
            assert [(a["text"], a["source_idx"]) for a in atoms] == atomize(doc, gs, ms)
            assert [a["idx"] for a in atoms] == list(range(len(atoms)))
            assert counts == [len(sentences(p[1])) if is_split(p) else -1 for p in doc]
            whole = lambda ts: " ".join(" ".join(ts).split())
            assert whole(a["text"] for a in atoms) == whole(p[1] for p in doc)


def pack(text, most):
    count = lambda s: int(len(s.split()) * 1.3)
    ss = sentences(text)
    if count(text) <= most or len(ss) <= 1:
        return [text]
    out, cur, n = [], [], 0
    for s in ss:
        if cur and n + count(s) > most:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += count(s)
    return out + ([" ".join(cur)] if cur else [])


def test_split_by_tokens(spark):
    docs = documents(seed=8)
    for doc, (parts,) in zip(docs, ordered(frame(spark, docs), P.split_by_tokens(F.col("p"), 9).alias("x"))):
        assert [p["text"] for p in parts] == [t for p in doc for t in (pack(p[1], 9) if is_split(p) else [p[1]])]


def sample(items, most):
    if len(items) <= most:
        return items
    third = most // 3
    head, tail = items[:third], items[-third:]
    rest = most - len(head) - len(tail)
    if rest <= 0:
        return head + tail
    start = max(len(items) // 2 - rest // 2, len(head))
    return head + items[start : min(start + rest, len(items) - len(tail))] + tail


def test_sample(spark):
    docs = documents(seed=9)
    for most in range(1, 9):
        for doc, (got,) in zip(docs, ordered(frame(spark, docs), P.sample(F.col("p"), most).alias("x"))):
            assert [p["idx"] for p in got] == [p[0] for p in sample(doc, most)]


def adjust(plan, counts, paragraphs):
    gs, ms, lo, hi = plan["gs"], plan["ms"], plan["lo"], plan["hi"]
    if gs <= 0:
        return gs, ms
    n = estimate(counts, gs, ms)
    if n < lo:
        top = max([c for c in counts if c >= 0], default=0)
        start = min(ms, top) if top > 0 else ms
        hit = next(((g, m) for g in range(gs, 0, -1) for m in range(start, -1, -1) if estimate(counts, g, m) >= lo), None)
        if hit:
            gs, ms = hit
            n = estimate(counts, gs, ms)
    if plan["expected"] > paragraphs > 0 and plan["expected"] / paragraphs >= 1.5 and gs > 2 and estimate(counts, 2, ms) <= hi * 3:
        gs, n = 2, estimate(counts, 2, ms)
    while n > hi * 3 and gs < 6:
        gs += 1
        n = estimate(counts, gs, ms)
    return gs, ms


def test_safe_plan(spark):
    r = random.Random(12)
    rows, wants = [], []
    for i in range(400):
        counts = [r.choice([-1, *range(0, 30)]) for _ in range(r.randint(0, 12))]
        lo = r.randint(1, 30)
        plan = {"topics": [], "expected": r.randint(1, 40), "lo": lo, "hi": lo + r.randint(0, 5), "gs": r.randint(0, 10), "ms": r.randint(0, 15), "rationale": "", "confidence": 0.5}
        rows.append((i, counts, tuple(plan.values())))
        wants.append(adjust(plan, counts, len(counts)))
    df = spark.createDataFrame(rows, "i int, c array<int>, p struct<topics:array<string>,expected:int,lo:int,hi:int,gs:int,ms:int,rationale:string,confidence:double>")
    got = ordered(df, G.safe_plan(F.col("p"), F.col("c"), F.size("c")).alias("x"))
    assert [(x["gs"], x["ms"]) for (x,) in got] == wants
    assert all(bool(x["rationale"]) == ((x["gs"], x["ms"]) != (row[2][4], row[2][5])) for (x,), row in zip(got, rows))


def test_normalise_plan(spark):
    cases = [
        ({}, (7, 5, 9, 0, 6, "", 0.0, [])),
        ({"expected_chunk_count": "2.5", "confidence": 3}, (2, 1, 4, 0, 6, "", 1.0, [])),
        ({"expected_chunk_count": 12, "expected_chunk_count_range": [9, 3], "topics": " a, b ,"}, (12, 3, 9, 2, 6, "", 0.0, ["a", "b"])),
        ({"expected_chunk_count": True, "atomize_sentences_per_paragraph": 99, "atomize_min_sentences": -4, "rationale": "r", "topics": ["x", "y"]}, (1, 1, 3, 10, 0, "r", 0.0, ["x", "y"])),
        ({"expected_chunk_count": "many", "confidence": "no"}, (7, 5, 9, 0, 6, "", 0.0, [])),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, r string")
    for (x,), (_, want) in zip(ordered(df, G.normalise_plan(F.col("r"), F.lit(7), 6).alias("x")), cases):
        assert (x["expected"], x["lo"], x["hi"], x["gs"], x["ms"], x["rationale"], x["confidence"], x["topics"]) == want
