"""The pipeline's stages one after the other, and the registry."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages(spark):
    import corpus_pipeline
    from passagemill.llm import decontaminate, jaccard_join, pii

    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = df.columns, {r["doc_id"] for r in df.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "personal data", "source mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, stage(spark, df, SF)
        left = {r["doc_id"] for r in df.select("doc_id").collect()}
        assert left <= ids
        if name == "n-gram Jaccard join":
            firsts = jaccard_join.jaccard_classes(before).where("doc_id = component_id")
            assert left == {r["doc_id"] for r in firsts.collect()}
        if name == "benchmark decontamination":
            found = decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert left == ids - {r["doc_id"] for r in found.collect()}
        if name in ("personal data", "source mixing"):
            assert left == ids
        if name == "personal data":
            assert pii.pii_digest(df).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert df.where("n_chars <> length(text)").count() == 0
        assert df.columns == columns + ["block", "slot", "place"] * (name == "source mixing")
        ids = left


def test_run_equals_stages(spark):
    """The whole run, texts included, is what the stages make one after the other; nothing but its last table is left."""
    import corpus_pipeline
    from passagemill.llm import common

    df = spark.read.parquet(f"{SF}/documents.parquet")
    before = len(common.written)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == [*df.columns, "block", "slot", "place"] and len(common.written) == before + 1
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).cache()
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(whole) == rows(df) and whole.count() > 100


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def test_pipeline_by_brute_force(spark):
    """What the run keeps, from the tables alone: loops for copies, leaks, personal data and the order."""
    import corpus_pipeline
    import test_copies
    import test_native

    from passagemill.llm import quality_rules

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in quality_rules.op3_quality_rules(spark, SF).where("kept").collect()}
    for i in kept:
        n, _, _, _, repeats = test_native.measured(docs[i]["text"])
        assert n >= 10 and 100 * repeats <= 20 * n
    firsts = {i for i, (_, c) in test_copies.classes([(i, docs[i]["text"]) for i in kept]).items() if i == c}
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in firsts if not any(f" {x} " in f" {plain(docs[i]['text'])} " for x in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= clean and len(clean - set(got)) <= 0.01 * len(clean)  # of the rest, leaks that are no exact ones
    for i, r in got.items():
        if not test_native.spans(docs[i]["text"]) and r["text"] != docs[i]["text"]:
            assert re.search(r"\[(iban|ssn|shortcard)\]", r["text"])
        assert not test_native.spans(r["text"]) and r["n_chars"] == len(r["text"]) and r["source"] == docs[i]["source"]
    for source in {r["source"] for r in got.values()}:
        own = sorted((r["place"], r["n_chars"], r["block"]) for r in got.values() if r["source"] == source)
        total = 0
        for p, n, b in own:
            assert p == total and b == p // (1 << 16)
            total += n


def test_decontamination_stage_spans_all_documents(spark, monkeypatch, tmp_path):
    """Each of 20 documents pairs two words of its own, and the benchmark others: a space of rank 20 that holds all those pairs took every document."""
    import corpus
    import corpus_pipeline
    import numpy as np

    from passagemill.llm import decontaminate

    built, build = [], decontaminate.build
    monkeypatch.setattr(decontaminate, "build", lambda *args: built.append(build(*args)) or built[-1])
    monkeypatch.setattr(decontaminate, "SAMPLE", 1)
    monkeypatch.setattr(decontaminate, "RANK", 20)
    monkeypatch.setattr(decontaminate, "EMPHASIS", 1e-3)
    spark.createDataFrame([(k, f"a{k} c{k} b{(k + 1) % 20} d{k}") for k in range(20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus.frame(spark, [(k, f"a{k} b{k} " * 16, "", "", 0) for k in range(20)]).repartition(5)
    assert corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).count() == 20

    (index,) = built
    idf = decontaminate.statistics(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).idf(index.vocabulary)
    for k in range(20):
        pair = np.isin(index.vocabulary, np.concatenate(decontaminate._words([f"a{k} b{k}"]))) / 2**0.5
        assert np.linalg.norm(pair @ (index.weights / idf[:, None])) > 0.99


@pytest.fixture(scope="module")
def extremes(spark):
    """A text of some MB, one of a single word that long, rows without an id, without a text, and twice the same."""
    import random

    import corpus

    r = random.Random(11)
    long = " ".join(r.choice(["the", "of", "software", "license", "4111 1111 1111 1111", "a@b.co"]) if r.random() < 0.1 else f"w{r.randrange(50_000)}" for _ in range(400_000))
    rows = [(1, long), (2, "x" * 2_000_000), (None, "a short text without an id, which is there all the same and has some words"), (None, None), (3, None), (4, ""), (5, long), (5, long)]
    return rows, corpus.frame(spark, [(i, t, "en", None, len(t or "")) for i, t in rows]).cache()


def test_extremes(spark, extremes):
    """Every operator takes them, and returns a row for each where it returns rows of documents."""
    from passagemill.llm import decontaminate, jaccard_join, licenses, mixing, pii, quality_model, quality_rules, substrings

    rows, df = extremes
    ids = lambda f: sorted(str(r[0]) for r in f.select("doc_id").collect())
    every = sorted(str(i) for i, _ in rows)
    words = rows[0][1].split()
    bench = spark.createDataFrame([(1, " ".join(words[1000:1030])), (2, " ".join(words[-40:]))], "item_id long, text string")
    leaks = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()]
    assert sorted(leaks) == sorted((d, i) for d in (1, 5, 5) for i in (1, 2))
    assert ids(decontaminate.drop_leaks(df, bench)) == sorted(["2", "3", "4", "None", "None"])
    assert ids(mixing.mix_sources(df)) == every and ids(pii.pii_digest(df)) == every and ids(pii.redact(df)) == every
    judged = quality_rules.judge(df)
    assert ids(judged) == every and {r["n_words"] for r in judged.where("doc_id = 1").collect()} == {len(words)}
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    assert ids(quality_model.score_quality(df, quality_model.learn(df, labels))) == every
    classes = [(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect()]
    assert sorted(classes, key=repr) == sorted([(1, 1), (2, 2), (None, None), (None, None), (3, 3), (4, 4), (5, 1), (5, 1)], key=repr)
    assert ids(jaccard_join.keep_firsts(df)) == sorted(["1", "2", "3", "4", "None", "None"])
    kept = substrings.drop_repeats(df)
    assert ids(kept) == every and {r["n_removed"] for r in kept.where("doc_id = 5").collect()} == {len(words)}
    assert licenses.scan_licenses(df).unionAll(licenses.embedded_notices(df)).count() == 0


def test_registry(spark):
    from passagemill.llm.registry import ORACLES, QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if not n.startswith("base_")) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op5_licenses", "op7_jaccard_join", "op8_substrings", "op9_url_filter", "base_quality", "base_personal_data"])
def test_same_as_sql(spark, name):
    import duckdb

    from passagemill.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda f: sorted(tuple(repr(x) for x in r) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
    assert rows(want) == rows(got)


def test_native_plans_have_no_python(spark):
    from passagemill.llm.registry import QUERIES

    for name in ("op2_mixing", "op3_quality_rules", "op5_licenses", "op9_url_filter", "op10_pii"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "ArrowEval")), name
