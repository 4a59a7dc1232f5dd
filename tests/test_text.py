"""Text functions against Python's own, on random input with odd white space."""

import random
from collections import Counter
import re

from pyspark.sql import functions as F

from passagemill.functions import keywords as K
from passagemill.functions import text as X

ALPHABET = ["a", "Bc", "thing", "Thing", "word", "é", "3.14", "e.g.", "x.", "y!", "z?", "...", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "-", "it's", "the", "with"]


def texts(n=200, seed=3):
    r = random.Random(seed)
    return ["", " ", "\n\n"] + ["".join(r.choice(ALPHABET) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def column(spark, rows, expression):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", expression.alias("x")).collect())]


def sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def test_words_sentences_tokens(spark):
    rows = texts()
    t = F.col("t")
    assert column(spark, rows, X.collapse(t)) == [" ".join(x.split()) for x in rows]
    assert column(spark, rows, X.sentences(t)) == [sentences(x) for x in rows]
    assert column(spark, rows, X.approx_tokens(t)) == [int(len(x.split()) * 1.3) for x in rows]
    assert column(spark, rows, X.truncate_words(t, 7)) == [" ".join(x.split()[: int(7 / 1.3)]) for x in rows]


def test_paragraphs(spark):
    rows = ["a\r\n\r\nb", "a\n \nb", "a\n\n\n\nb  c", "", None, "caf\xe9\n\nx"]
    want = [["a", "b"], ["a b"], ["a", "b c"], [], [], ["caf\xe9", "x"]]
    assert column(spark, rows, X.text_paragraphs(F.col("t"))) == want


def test_previews(spark):
    rows = ["x" * 500, "y" * 501]
    assert column(spark, rows, X.tail_preview(F.col("t"))) == ["x" * 500, "..." + "y" * 500]
    assert column(spark, rows, X.head_preview(F.col("t"))) == ["x" * 500, "y" * 500 + "..."]


def simple_keywords(t):
    clean = Counter(re.sub(r"[\W_]", "", w) for w in t.lower().split())
    return [w for w, _ in Counter({w: n for w, n in clean.items() if len(w) > 3 and w not in set(K.STOP_WORDS)}).most_common(5)]


def test_keywords(spark):
    rows = texts(seed=5)
    assert column(spark, rows, K.simple_keywords(F.col("t"))) == [simple_keywords(x) for x in rows]


def lists(seed):
    r = random.Random(seed)
    pool = ["Alpha", "alpha", "beta?", "Beta", " gamma ", "", "  ", "delta", "what is alpha?", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu"]
    return [[r.choice(pool) for _ in range(r.randint(0, 18))] for _ in range(150)]


def deduped(items, most):
    seen, out = set(), []
    for x in items:
        if x.lower() not in seen:
            seen.add(x.lower())
            out.append(x)
    return out[:most]


def covered(qs, kws):
    asked, wanted = list(filter(str.strip, qs)), list(filter(str.strip, kws))
    everything = "\n".join(asked).lower()
    lost = [k for k in wanted if k.lower() not in everything]
    if len(lost) <= max(1, len(wanted) // 3):
        return asked[:8]
    more = [f"Explain {k}?" for k in lost]
    spelled = {q.lower(): q for q in reversed(more)}
    return (asked + [spelled[q] for q in dict.fromkeys(map(str.lower, more)) if q not in set(map(str.lower, asked))])[:8]


def test_given_questions_and_keywords(spark):
    a, b = lists(1), lists(2)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "i int, a array<string>, b array<string>")
    rows = sorted(df.select("i", K.normalise_questions(F.col("a")).alias("q"), K.normalise_keywords(F.col("b")).alias("k"), K.cover_keywords(F.col("a"), F.col("b")).alias("c"), K.fallback_questions(F.col("b")).alias("f")).collect())
    for (i, q, k, c, f), x, y in zip(rows, a, b):
        asked = [s if s.endswith("?") else s + "?" for s in (v.strip() for v in x) if s]
        assert q == deduped(asked, 8)
        keys = [v.strip() for v in y if v.strip()]
        assert k == deduped(keys, 12)
        assert c == covered(x, y)
        want = [f"What is {keys[0]}?"] + ([f"How does {keys[0]} relate to {', '.join(keys[1:4])}?", f"Explain {keys[1]}.?"] if len(keys) > 1 else []) if keys else []
        assert f == want


def test_titles_and_enums(spark):
    rows = ["x" * 50, "x" * 51, "One. Two", "merge", " MERGE", "maybe", "Adjust", ""]
    assert column(spark, rows, K.fallback_title(F.col("t")))[:3] == ["x" * 50, "x" * 50 + "...", "One"]
    assert column(spark, rows, K.verdict(F.col("t")))[3:] == ["MERGE", "KEEP", "KEEP", "ADJUST", "KEEP"]
    assert column(spark, ["Warns", "other"], K.intent(F.col("t"))) == ["warns", "unknown"]
    assert len(K.STOP_WORDS) == len(set(K.STOP_WORDS)) > 90
