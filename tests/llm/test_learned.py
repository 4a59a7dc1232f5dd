"""The classifier, page extraction and decontamination: accuracy, exact cases and edge cases."""

import html
import random
import re
from collections import Counter

import corpus
import hand_pages
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.llm import decontaminate, html_text, quality_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights():
    return html_text.train()


def test_marginals_are_exact():
    """Sum-product on a small tree against all labellings."""
    tree = html_text.Tree("<body><nav><ul><li>a</li></ul></nav><article><p>b c d</p></article></body>")
    forest = html_text.Forest([tree])
    rng = np.random.default_rng(0)
    node, edge = rng.normal(size=html_text.WIDTH), rng.normal(size=(2, 2))
    n = len(tree.tag)
    unary = node[forest.x].sum(axis=1)
    total, mass, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        p = np.exp(sum(unary[k] * y[k] for k in range(n)) + sum(edge[y[tree.parent[k]], y[k]] for k in range(1, n)))
        total += p
        mass += p * np.array(y)
        for k in range(1, n):
            pairs[y[tree.parent[k]], y[k]] += p
    got, seen = forest.marginals(node, edge)
    assert np.allclose(got, mass / total) and np.allclose(seen, pairs / total)


def test_held_out_pages(weights):
    pages = html_text.labelled_pages(150, 4242)
    trees = [html_text.Tree(p) for p in pages]
    content, _ = html_text.Forest(trees).marginals(*weights)
    y = np.array(["data-y" in m for t in trees for m in t.marks])
    assert ((content >= 0.5) == y).mean() > 0.98


def test_extraction(spark, weights):
    def text(page):
        return html_text.extract([page], *weights)[0][0]

    shell = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>%s<footer>&copy; 2020 x</footer></body></html>'
    assert text(shell % "<article><h1>The   head</h1><p>One &amp; <b>t</b>wo&nbsp;x<br>three<p>four<script>var t='</p>'</script></article>") == "The head One & two x three four"
    assert text(shell % "<!-- <p>no</p> --><article><p>a &am b &amp c</p></article>") == "a &am b & c"
    assert text("") == "" and text("<nav><ul><li><a href=x>only menu</a></li></ul></nav>") == ""
    long = " ".join(f"w{i}" for i in range(60_000))
    assert text(shell % f"<article><p>{long}</p></article>") == long
    rows = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (2, None, shell % "<article><p>x y z</p></article>", 1)], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.main_text(rows).collect())
    assert got == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "x y z", 5)]
    assert html_text.main_text(rows.limit(0)).count() == 0


def shares(got, want):
    """Precision and recall of the words."""
    g, x = Counter(got.split()), Counter(want.split())
    common = sum((g & x).values())
    return (common / sum(g.values()) if g else float(not x)), (common / sum(x.values()) if x else float(not g))


@pytest.mark.parametrize("layout", hand_pages.PAGES)
def test_layouts(weights, layout):
    """Pages that the generator did not make."""
    page, want = hand_pages.PAGES[layout]
    assert min(shares(html_text.extract([page], *weights)[0][0], want)) >= 0.95


def test_layouts_not_seen_before(weights):
    found = [shares(html_text.extract([page], *weights)[0][0], want) for page, want in hand_pages.FRESH.values()]
    assert np.mean([p for p, _ in found]) >= 0.9 and np.mean([r for _, r in found]) >= 0.95


def test_given_pages(spark):
    pytest.importorskip("duckdb")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op6_html_text(spark, SF).collect():
        body = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)
        assert r["text"] == " ".join(html.unescape(plain).split())


def test_classifier_on_held_out_documents(spark):
    scored = quality_model.op4_quality_model(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.95 and len(rows) > 80
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1").count() == 0


def loss(model, x, bag, y):
    """Mean log loss, bag by bag in plain loops."""
    p, total = model.parts, 0.0
    for k in range(len(y)):
        h = np.tanh(x[bag == k] @ p["w"] + p["b"])
        e = [float((np.tanh(r @ p["v"]) / (1 + np.exp(-(r @ p["u"])))) @ p["g"]) for r in h]
        a = np.exp(e) / np.sum(np.exp(e))
        score = 1 / (1 + np.exp(-float((a @ h) @ p["c"] + p["d"][0])))
        total -= y[k] * np.log(score) + (1 - y[k]) * np.log(1 - score)
    return total / len(y)


def test_classifier_gradient():
    """Against finite differences of a loss written out in loops."""
    rng = np.random.default_rng(1)
    bag = np.array([0, 0, 0, 1, 2, 2, 3, 3, 3, 3])
    x, y = rng.normal(size=(10, quality_model.N_FEATURES)), np.array([0.0, 1, 1, 0])
    parts = quality_model.start(np.float64)
    model = quality_model.Model(np.zeros(1), np.ones(1), parts)
    grad = model.gradient(x, bag, y)
    for name, w in parts.items():
        for at in rng.integers(0, w.size, 12):
            kept = w.flat[at]
            w.flat[at] = kept + 1e-5
            up = loss(model, x, bag, y)
            w.flat[at] = kept - 1e-5
            down = loss(model, x, bag, y)
            w.flat[at] = kept
            assert abs((up - down) / 2e-5 - grad[name].flat[at]) < 1e-7, name


def test_classifier_training():
    """Training finds what decides, and attention weighs passages of one document to one."""
    rng = np.random.default_rng(1)
    bag = np.repeat(np.arange(50), 4)
    x = rng.normal(size=(200, quality_model.N_FEATURES))
    y = (np.add.reduceat(x[:, 0], np.arange(0, 200, 4)) > 0).astype(float)
    model = quality_model.fit(x, bag, y)
    f = model.forward(model.scaled(x), bag, 50)
    assert ((f["score"] >= 0.5) == y).mean() > 0.95
    assert np.allclose(np.bincount(bag, f["a"]), 1, atol=1e-5)


def topics(seed, n, size=80):
    """Documents that only their words tell apart: the same letters, lengths and marks."""
    r = random.Random(seed)
    words = ["".join(p) for p in ("abcdef", "abcdfe", "abcedf", "abcefd", "abcfde", "abcfed", "abdcef", "abdcfe", "abdecf", "abdefc", "abdfce", "abdfec")]
    return [(i, " ".join(r.choice(words[6 * (i % 2) :][:6]) if r.random() < 0.7 else r.choice(words) for _ in range(size)), "", "", 0) for i in range(n)]


def test_classifier_sees_words(spark):
    rows = topics(1, 600)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    df = corpus.frame(spark, rows)
    model = quality_model.learn(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score_quality(df, model).collect()}
    held = {r["doc_id"] for r in df.where(quality_model.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert sum((got[i] >= 0.5) == i % 2 for i in held) > 0.95 * len(held) and len(held) > 100
    scrambled = [(i, t.translate(str.maketrans("abcdef", "fabcde")), *x) for i, t, *x in rows[:20]]
    other = {r["doc_id"]: r["score"] for r in quality_model.score_quality(corpus.frame(spark, scrambled), model).collect()}
    assert sum(abs(other[i] - got[i]) > 0.05 for i in other) > 10


def test_classifier_learns_from_long_documents(spark):
    """What tells the classes apart is only in documents of more passages than are sampled."""
    rows = topics(3, 60, quality_model.PASSAGE * (quality_model.MAX_TRAIN_PASSAGES + 20))
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    df = corpus.frame(spark, rows)
    got = quality_model.score_quality(df, quality_model.learn(df, labels)).collect()
    assert sum((r["score"] >= 0.5) == r["doc_id"] % 2 for r in got) > 55


def test_classifier_without_the_measures(spark, monkeypatch):
    """Words alone say most of it, too."""
    whole = quality_model.passages

    def words_only(words):
        x, doc = whole(words)
        x[:, : quality_model.N_MEASURES] = 0
        return x, doc

    monkeypatch.setattr(quality_model, "passages", words_only)
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", quality_model.held_out(F.col("doc_id")).alias("h")).toPandas()
    batch = lambda f: pa.RecordBatch.from_pandas(f, preserve_index=False)
    bags = [(q, x) for b in quality_model._measured(iter([batch(rows[~rows.h])])) for q, x in zip(b["quality"].to_pylist(), b["x"].to_pylist())]
    (scored,) = quality_model._scored(iter([batch(rows[rows.h])]), quality_model.fit_bags(bags))
    assert ((np.array(scored["score"]) >= 0.5) == rows[rows.h].quality).mean() > 0.85


def test_classifier_edge_cases(spark, docs, nothing):
    rows, df = docs
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows] + [(20, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.learn(df, labels)
    got = quality_model.score_quality(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    again = {r["doc_id"]: r["score"] for r in quality_model.score_quality(df.repartition(7), model).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    empty = quality_model.learn(df, labels.limit(0))
    assert {r["score"] for r in quality_model.score_quality(df, empty).collect()} == {0.5}
    assert quality_model.score_quality(nothing, model).count() == 0
    folds = df.select(quality_model.held_out(F.col("doc_id")).alias("h"), "doc_id").collect()
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in folds)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = [[r.randrange(6) for _ in range(r.randint(0, 40))] for _ in range(2)]
        assert decontaminate.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == lcs(a, b)


def planted(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(r.randint(10, 150 if k % 5 == 0 else 55))) + ".") for k in range(40)]
    rows, want = [], set()
    for i in range(160):
        body = [word() for _ in range(r.randint(20, 300))]
        if i % 4 == 0:
            k = r.randrange(40)
            leak = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: some words replaced, some added
                leak = [w for x in leak for w in ([word()] if r.random() < 0.12 else [x, word()] if r.random() < 0.08 else [x])]
            if i % 12 == 0:
                leak = [w.upper() + "!!" for w in leak]
            at = r.randrange(len(body))
            body[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(body), "", "", 0))
    return rows, items, want


def test_planted_leaks(spark):
    """Recall against the plan, and nothing else found."""
    rows, items, want = planted()
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "..."), (0, items[0][1])], "item_id long, text string").withColumn("key", F.lit(1))
    df = corpus.frame(spark, [*rows, (500, None, "", "", 0), (501, "", "", "", 0), rows[0]])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert len(got & want) >= 0.95 * len(want) and got <= want
    clean = decontaminate.drop_leaks(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in got} | {500, 501}


def test_brief_items(spark):
    """A word that many texts hold is no leak; a brief item of rare words is one where it stands word by word."""
    r = random.Random(4)
    pool = ["alpha", "yes", "no", *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(r.choice(pool[:12]) if r.random() < 0.4 else r.choice(pool) for _ in range(80)), "", "", 0) for i in range(30)]
    rows[3] = (3, rows[3][1] + " zebra quagga OKAPI, no", "", "", 0)
    rows[4] = (4, rows[4][1] + " zebra yes quagga yes okapi", "", "", 0)
    bench = spark.createDataFrame([(1, "alpha"), (2, "yes"), (3, "Zebra quagga okapi!"), (4, "zebra")], "item_id long, text string")
    df = corpus.frame(spark, rows)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()} == {(3, 3)}
    assert decontaminate.drop_leaks(df, bench).count() == 29


def test_ids_of_any_type(spark):
    text = "some words of an item that is here and there in full"
    docs = spark.createDataFrame([("a", text), (None, text), ("b", "none of it"), ("a", text)], "doc_id string, text string")
    bench = spark.createDataFrame([("x", text), (None, text)], "item_id string, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(d, i) for d in ("a", "a", None) for i in ("x", None)], key=repr)


def test_many_items_in_blocks_with_a_small_sample(spark, monkeypatch):
    """3,000 items in blocks, a twentieth of the corpus spanning the space, a text repeated often: recall of paraphrases by the plan."""
    monkeypatch.setattr(decontaminate, "ITEMS", 800)
    monkeypatch.setattr(decontaminate, "SAMPLE", 60)
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(6000)]
    word = lambda: words[int(r.random() ** 3 * len(words))]
    items = [(k, " ".join(word() for _ in range(r.randint(12, 50)))) for k in range(3000)]
    rows, want = [], set()
    for i in range(800):
        body = [word() for _ in range(r.randint(40, 300))]
        if i % 2 == 0:
            k = r.randrange(3000)
            leak = [w for x in items[k][1].split() for w in ([word()] if r.random() < 0.12 else [x, word()] if r.random() < 0.08 else [x])]
            at = r.randrange(len(body))
            body[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(body), "", "", 0))
    rows += [(1000 + i, "one text that is there again and again " * 5, "", "", 0) for i in range(400)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(corpus.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.01 * len(want)


def test_exact_leaks_in_given_tables(spark):
    """Against a search for every item in every text, case and punctuation aside."""
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_decontaminate(spark, SF).collect()}
    assert want and got == want


def test_no_items_or_documents(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "some words of an item that is here")], "item_id long, text string")
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.drop_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(docs[1], bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs[1], bench.limit(0)).count() == len(docs[0])


def test_every_document_spans_the_latent_space(spark, monkeypatch):
    """The directions are those of an exact decomposition over all half passages of all documents."""
    monkeypatch.setattr(decontaminate, "SAMPLE", 1)
    monkeypatch.setattr(decontaminate, "TERMS", 7)
    monkeypatch.setattr(decontaminate, "STEPS", 5)
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(words[int(r.random() ** 2 * 40)] for _ in range(20))) for k in range(30)]
    texts = [" ".join(words[int(r.random() ** 3 * 40)] for _ in range(r.randint(1, 200))) for _ in range(120)]
    docs = corpus.frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]).repartition(5)
    known = decontaminate.statistics(docs, spark.createDataFrame(items, "item_id long, text string"))
    index = decontaminate.build(known, items)

    place = {w: i for i, w in enumerate(index.vocabulary.tolist())}
    name = {w: place[int(decontaminate._words([w])[0][0])] for _, t in items for w in t.split()}
    count = lambda ws: np.bincount([name[w] for w in ws if w in name], minlength=len(place))
    idf = known.idf(index.vocabulary).astype(float)
    whole = np.array([count(t.split()[a : a + 32]) for t in texts for a in range(0, len(t.split()), 32)]) * idf
    bench = np.array([count(t.split()) for _, t in items]) * idf
    assert known.passages == len(whole)
    energy = [sum((np.bincount([name[w] for w in t.split() if w in name], minlength=len(place)) * idf**2).sum() for t in ts) for ts in (texts, [t for _, t in items])]
    gram = whole.T @ whole + decontaminate.EMPHASIS * energy[0] / energy[1] * bench.T @ bench
    want = np.linalg.eigh(gram)[1][:, ::-1]
    got = index.weights / idf[:, None]
    assert (abs((got * want).sum(axis=0))[:8] > 0.999).all()


def test_sums_by_group(monkeypatch):
    monkeypatch.setattr(decontaminate, "STEPS", 4)
    r = np.random.default_rng(1)
    rows = r.integers(0, 9, (30, 3)).astype(np.float32)
    for n in (0, 1, 5, 300):
        group, item = np.minimum(r.integers(0, 9, n), r.integers(0, 9, n)), r.integers(0, 30, n)
        want = np.zeros((11, 3), np.float32)
        np.add.at(want, group, rows[item])
        assert (decontaminate._sums(group, rows, item, 11) == want).all()
