"""Small documents with everything that breaks things."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_texts():
    return [
        None, "", " \n\t", "one", "one two three four", "ONE two three four five", "word " * 400, "a" * 5000, "é\u2003ü\x0bx\x1cy", "!!!", "\n\n\n",
        "tab\tseparated\twords and some more words here to pass", "x\u0000y z",
    ]


def passage(r, n, pool=400):
    return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.2 else f"w{r.randrange(pool)}" for _ in range(n))


def documents(seed=1, n=60):
    """Exact and near copies, shared passages, repeats, edge cases and repeated rows."""
    r = random.Random(seed)
    texts = edge_texts()
    shared = passage(r, 40)
    for _ in range(n):
        kind = r.random()
        if kind < 0.25 and len(texts) > 20:
            texts.append(r.choice(texts[13:]))
        elif kind < 0.55 and len(texts) > 20:
            words = (r.choice(texts[13:]) or "").split()
            for _ in range(max(1, len(words) // 40)):
                if words:
                    words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind < 0.7:
            texts.append(passage(r, 30) + "\n" + shared + " " + passage(r, 30))
        else:
            texts.append(passage(r, r.randint(5, 200)))
    rows = [(i, t, "en", f"src{min(3, r.randrange(9))}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[30], rows[30], rows[1]]


def frame(spark, rows):
    """The documents with extra columns that operators use names like."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS key", "2 AS rank", "3 AS measures", "4 AS spans", "5 AS did", "6 AS label", "7 AS pattern")


def unique(rows):
    return list({r[0]: r for r in rows}.values())
