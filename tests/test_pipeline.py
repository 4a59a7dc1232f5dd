"""Runs from end to end, with and without a model, and what must hold of any run."""

import asyncio
import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagemill import cli
from passagemill.config import Config
from passagemill.errors import ConfigError, ModelError
from passagemill.functions import vectors as V
from passagemill.operators import boundaries as B
from passagemill.plans.pipeline import Chunker, Pipeline
from passagemill.plans.stages import Context, default_stages
from passagemill.providers import BpeCounter, FixedModel, FunctionModel, HashEmbedder, HttpChatModel, Retry, complete_json, count_tokens, embed
from passagemill.sinks import export_markdown, metadata_from_json, write_calls, write_chunks, write_markdown
from passagemill.sources.registry import from_texts
from passagemill.streaming.files import chunk_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests
LONG = "Cats purr a lot. Cats sleep. Cats eat. Cats play. Stocks fall today! Stocks rise. Bonds pay? Bonds wait. Rain falls. Snow falls. Wind blows. Sun shines."


def test_text_run(spark):
    result = Chunker(spark).run(from_texts(spark, [LONG, "One. Two.", "", None]))
    assert result.success
    docs = {r["doc_id"]: r for r in result.documents.collect()}
    assert [len(docs[i]["chunks"]) for i in range(4)] == [5, 1, 0, 0]
    assert not docs[0]["short"] and docs[1]["short"]
    assert [c["metadata"]["chunk_id"] for c in docs[0]["chunks"]] == [f"chunk_{n:03d}" for n in range(1, 6)]
    assert " ".join(c["content"] for c in docs[0]["chunks"]).replace("\n\n", " ") == LONG
    assert [e["message"] for e in docs[2]["events"]] == ["short document: 0 paragraphs", "document has no paragraphs"]
    metrics = {r["key"]: r["value"] for r in result.metrics.where("doc_id = 0").collect()}
    assert (metrics["paragraphs_before_atomize"], metrics["atoms_total"], metrics["chunks_formed"], metrics["boundaries_kept"]) == ("1", "6", "5", "4")
    assert result.chunk_count() == 6 and result.has_warnings() and not result.has_errors()
    assert result.to_dict()["total_tokens"] == result.total_tokens() > 0


def test_dry_run_is_one_bare_chunk(spark):
    result = Chunker(spark, model=FixedModel(fails=True)).run(from_texts(spark, [LONG]), dry_run=True)
    (chunk,) = result.chunks.collect()
    assert chunk["metadata"] is None and chunk["content"].count("\n\n") == 5
    assert result.calls.isEmpty()


def reply(prompt):
    if "Sample:" in prompt:
        return json.dumps({"expected_chunk_count": 4, "atomize_sentences_per_paragraph": 3, "atomize_min_sentences": 4, "topics": ["t"]})
    if "Before the break" in prompt:
        return '```json\n{"verdict": "%s", "confidence": 0.7}\n```' % ("merge" if "Stocks" in prompt.split("After the break")[1] else "KEEP")
    return json.dumps({"title": "T", "summary": "S", "intent": "WARNS", "questions": "- why\n- why?\n", "keywords": "cats, Cats, dogs"})


def test_model_run(spark):
    result = Chunker(spark, Config(similarity_threshold=1.0), FunctionModel(reply)).run(from_texts(spark, [LONG]))
    (doc,) = result.documents.collect()
    # Four passages of one paragraph: the plan's groups of three are made pairs.
    assert doc["plan"]["gs"] == 2 and doc["plan"]["ms"] == 4 and "2 sentences/group" in doc["plan"]["rationale"] and len(doc["paragraphs"]) == 6
    assert [d["verdict"] for d in doc["decisions"]] == ["KEEP", "MERGE", "KEEP", "KEEP", "KEEP"]
    assert [c["metadata"]["intent"] for c in doc["chunks"]] == ["warns"] * 5
    assert doc["chunks"][0]["metadata"]["keywords"] == ["cats", "dogs"]
    assert doc["chunks"][0]["metadata"]["questions"] == ["why?", "Explain cats?", "Explain dogs?"]
    assert all("Passage:" in r["prompt"] and r["system_prompt"] for r in result.calls.where("kind = 'enrich'").collect())
    assert {r["kind"]: r["n"] for r in result.calls.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"plan": 1, "check": 5, "enrich": 5}


def test_model_failures_fall_back(spark):
    docs = from_texts(spark, [LONG])
    config = Config(similarity_threshold=1.0, retry_attempts=1)
    (doc,) = Chunker(spark, config, FixedModel(fails=True)).run(docs).documents.collect()
    assert {d["reason"] for d in doc["decisions"]} == {B.FAILED_REASON} and {d["confidence"] for d in doc["decisions"]} == {0.5}
    assert all(c["metadata"]["summary"] == "Content summary unavailable" for c in doc["chunks"])
    assert {e["stage"] for e in doc["events"]} == {"segment", "granularity", "atomize", "boundary_validate", "enrich"}
    bare = Chunker(spark, Config(retry_attempts=1, fallback_enabled=False), FixedModel(fails=True)).run(docs)
    assert bare.has_errors() and {c["metadata"] for c in bare.chunks.collect()} == {None}
    (odd,) = Chunker(spark, config, FixedModel('["a list"]')).run(docs).documents.collect()
    assert {d["verdict"] for d in odd["decisions"]} == {"KEEP"}


def test_embedder_and_similarity(spark):
    e = HashEmbedder(64)
    assert e.embed([]).shape == (0, 64)
    texts = [["a b", "a b", "c", ""], ["only"], None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>").withColumn("v", embed(e, F.col("t")))
    rows = sorted(df.select("i", V.adjacent_cosines(F.col("v")).alias("s"), V.statistics(V.adjacent_cosines(F.col("v"))).alias("st")).collect())
    assert rows[0]["s"] == pytest.approx([1.0, 0.0, 0.0]) and rows[1]["s"] == [] and rows[2]["s"] is None or rows[2]["s"] == []
    assert rows[0]["st"]["std"] == pytest.approx(np.std([1.0, 0.0, 0.0])) and rows[1]["st"]["median"] is None
    result = Chunker(spark, embedder=e).run(from_texts(spark, [LONG]))
    assert result.success and result.chunk_count() > 1


def test_threshold_is_strict_and_leaps_over_code(spark):
    p = [(0, "a", "paragraph", False, None, None, ""), (1, "code", "code_block", True, None, None, ""), (2, "b", "paragraph", False, None, None, ""), (3, "c", "paragraph", False, None, None, "")]
    from passagemill.schema import PARAGRAPHS

    df = spark.createDataFrame([(p, [0.5, 0.4])], f"p {PARAGRAPHS}, s array<double>")
    (row,) = df.select(B.propose(F.col("p"), F.col("s"), 0.5).alias("x"), B.propose(F.col("p"), F.col("s"), 0.6).alias("y")).collect()
    assert [x["position"] for x in row["x"]] == [3] and [y["position"] for y in row["y"]] == [2, 3]


def test_stage_list(spark):
    class Boom:
        name = "boom"

        def should_skip(self, context):
            return False

        def process(self, df, context):
            raise ValueError("no")

    seen = []
    result = Pipeline(Context()).insert(1, Boom()).run(from_texts(spark, ["x"]), lambda name, done: seen.append(name))
    assert result.errors == ["boom: no"] and seen == ["parse"]
    going = Pipeline(Context(Config(continue_on_error=True))).insert(1, Boom()).run(from_texts(spark, ["x"]))
    assert going.errors == ["boom: no"] and going.chunk_count() == 1
    p = Pipeline(Context(), default_stages())
    assert p.remove("enrich") and not p.remove("enrich") and "enrich" not in p.stage_names


def test_sinks(spark, tmp_path):
    result = Chunker.builder(spark).model(FunctionModel(reply)).config(Config()).build().run(from_texts(spark, [LONG]))
    files = export_markdown(result.documents, str(tmp_path / "md"))
    import yaml

    head = open(files[0]).read().split("---\n")[1]
    assert list(yaml.safe_load(head)) == ["chunk_id", "title", "summary", "intent", "questions", "keywords", "parent_section", "token_count"]
    write_markdown(result.documents, str(tmp_path / "table"))
    write_chunks(result.documents, str(tmp_path / "chunks"))
    write_calls(result.calls, str(tmp_path / "calls"), "run")
    assert spark.read.json(str(tmp_path / "table")).count() == 1
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == result.chunk_count()
    assert {r["type"] for r in spark.read.json(str(tmp_path / "calls")).collect()} == {"run_start", "llm_call"}
    back = spark.createDataFrame([('{"title": "t"}',)], "j string").select(metadata_from_json(F.col("j")).alias("m")).first()["m"]
    assert back["intent"] == "unknown" and back["keywords"] == [] and back["token_count"] == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(LONG)
    q = chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), Chunker(spark), once=True)
    q.awaitTermination(120)
    (tmp_path / "in" / "b.txt").write_text("One.")
    chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), Chunker(spark), once=True).awaitTermination(120)
    assert sorted(r["filename"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.txt"] * 5 + ["b.txt"]


def test_config(tmp_path, monkeypatch):
    assert Config.from_dict({"chunking": {}, "similarity_threshold": 0.9}).similarity_threshold == 0.5
    assert Config.from_dict({"similarity_threshold": 0.9, "other": 1}).similarity_threshold == 0.9
    monkeypatch.setenv("MODEL_NAME", "m1")
    (tmp_path / "c.yaml").write_text("llm:\n  model: ${MODEL_NAME}\nchunking:\n  min_tokens: 10\nretry_delay: 2\n")
    c = Config.from_yaml(tmp_path / "c.yaml")
    assert (c.llm_model, c.min_chunk_tokens, c.retry_delay) == ("m1", 10, 2)
    assert Config(**c.to_dict()) == c
    (tmp_path / "empty.yaml").write_text("")
    assert Config.from_yaml(tmp_path / "empty.yaml") == Config()
    with pytest.raises(ConfigError):
        Config.from_yaml(tmp_path / "none.yaml")
    for bad in ({"similarity_threshold": 1.1}, {"max_chunk_tokens": 1}, {"granularity_max_paragraphs": 0}, {"retry_attempts": -1}):
        with pytest.raises(ConfigError) as e:
            Config(**bad)
        assert e.value.key in bad


def test_retry_counts_attempts():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        Retry(3, 20.0, sleep=waits.append).run(fail)
    assert len(calls) == 3 and waits == [20.0, 30.0]
    with pytest.raises(ModelError):
        Retry(0).run(fail)
    with pytest.raises(ValueError):
        asyncio.run(Retry(2, 0).run_async(lambda: asyncio.sleep(0, fail())))


def test_json_replies_and_endpoint():
    assert complete_json(FixedModel('```json\n{"a": 1}\n```'), "p") == {"a": 1}
    with pytest.raises(ModelError):
        complete_json(FixedModel("no"), "p")
    down = HttpChatModel(base_url="http://127.0.0.1:9", timeout=1).complete("p")
    assert not down.success and down.error
    with pytest.raises(ConfigError):
        Chunker.with_api(None, None)


def test_bpe_counter(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    assert BpeCounter("/no/such/file").count("a b c") == 3 and BpeCounter("/no/such/file").count("") == 0
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    counter = BpeCounter(path)
    rows = spark.createDataFrame([(["Hello world", "", None],), (None,)], "t array<string>").select(count_tokens(counter, F.col("t"))).collect()
    assert counter.count("Hello world") == 2 and [r[0] for r in rows] == [[2, 0, 0], []]
    chunk = Chunker.builder(spark).counter(counter).build().run(from_texts(spark, ["Hello world"])).chunks.first()
    assert chunk["metadata"]["token_count"] == 2 and chunk["metadata"]["chunk_id"] == "chunk_001"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(LONG)
    assert cli.main([str(tmp_path / "a.txt"), "--api-key", ""]) == 1
    assert cli.main([str(tmp_path / "a.txt"), "--dry-run", "-v", "-o", str(tmp_path / "out")]) == 0
    assert "1 chunks" in capsys.readouterr().out and (tmp_path / "out" / "chunks_a.md").exists()
    assert cli.main([str(tmp_path / "a.txt"), "--dry-run", "-t", "2"]) == 1


def test_chunk_text_has_no_shuffle(spark):
    assert len(Chunker(spark).chunk_text(LONG)) == 5
    plan = Chunker(spark).run(from_texts(spark, [LONG])).chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_measured_run(spark):
    """Times and errors are of the work when asked for."""
    docs = registry_documents(spark)
    quick = Pipeline(Context()).run(docs)
    assert not quick.measured and quick.success

    class Fails:
        name = "fails"

        def should_skip(self, context):
            return False

        def process(self, df, context):
            return df.withColumn("x", F.raise_error(F.lit("on an executor")))

    late = Pipeline(Context()).add(Fails()).run(docs)
    assert late.success  # nothing has run yet
    found = Pipeline(Context()).add(Fails()).run(docs, measure=True)
    assert found.measured and not found.success and "on an executor" in found.errors[0]
    assert all(t > 0 for t in found.stage_times.values()) and found.chunk_count() > 0


def registry_documents(spark):
    from passagemill.sources import registry

    return registry.from_texts(spark, ["one a.\n\ntwo b.\n\nthree c.\n\nfour d.\n\nfive e."] * 3)


def test_missing_path_is_an_event(spark, tmp_path):
    from passagemill.sources import registry

    result = Pipeline(Context()).run(registry.read_files(spark, str(tmp_path / "none.md")))
    events = result.events.collect()
    assert any(e["level"] == "error" and "not found" in e["message"] for e in events) and result.chunk_count() == 0


def test_equal_names_make_files_of_their_own(spark, tmp_path):
    from passagemill.sinks import parse_rendered, write_stages

    for name in ("x/a.md", "y/a.md", "y/a.txt", "y/b.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(f"text of {name}")
    result = Chunker(spark).chunk_files(str(tmp_path / "in"))
    files = export_markdown(result.documents, str(tmp_path / "out"))
    assert len(set(files)) == 4 and sorted(os.listdir(tmp_path / "out")) == sorted(os.path.basename(f) for f in files)
    assert {c["content"] for f in files for c in parse_rendered(open(f).read())} == {f"text of {n}" for n in ("x/a.md", "y/a.md", "y/a.txt", "y/b.txt")}
    assert "chunks_b.md" in os.listdir(tmp_path / "out")
    assert write_stages(result.documents, str(tmp_path / "tables")) == ["chunks", "decisions", "paragraphs", "proposals"]
    assert spark.read.parquet(str(tmp_path / "tables" / "paragraphs")).count() == 4


def test_prompts_of_a_batch_are_asked_together(spark):
    """Rows of one prompt each don't wait for one another."""
    import time

    from passagemill.providers import Reply, ask

    class Slow:
        name = "slow"

        def complete(self, prompt, system=""):
            time.sleep(0.1)
            return Reply(prompt + "!", 1, "slow")

    df = spark.createDataFrame([(i, [f"p{i}"] if i % 9 else []) for i in range(90)], "i int, p array<string>").coalesce(1)
    began = time.time()
    rows = df.select("i", ask(Slow(), F.col("p"), threads=16).alias("r")).collect()
    assert {r["i"]: [x["content"] for x in r["r"]] for r in rows} == {i: [f"p{i}!"] if i % 9 else [] for i in range(90)}
    assert time.time() - began < 6


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
def test_bpe_of_a_real_vocabulary(spark, tmp_path):
    from passagemill.providers import BpeCounter, count_tokens, encoding_of, truncate_tokens

    counter = BpeCounter("/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "The harbour was rebuilt after the storm of 1911, when two piers were lost. Süße Grüße!"
    whole = counter.count(text)
    assert len(text.split()) < whole < len(text) and counter.truncate(text, whole) == text
    for n in range(1, whole):
        cut = counter.truncate(text, n)
        assert text.startswith(cut.rstrip("\ufffd")) and (cut.endswith("\ufffd") or counter.count(cut) <= n)
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = df.select(count_tokens(counter, F.array("t")).alias("n"), truncate_tokens(counter, F.col("t"), 4).alias("c")).collect()
    assert [r["n"] for r in rows] == [[whole], [0], [0]] and [r["c"] for r in rows] == [counter.truncate(text, 4), None, ""]
    assert (encoding_of("gpt-4"), encoding_of("gpt-4o"), encoding_of("nobody's")) == ("cl100k_base", "o200k_base", "cl100k_base")
    os.symlink("/opt/tokenizers/byte_bpe_50k.tiktoken", tmp_path / "r50k_base.tiktoken")
    assert BpeCounter.for_model("davinci", str(tmp_path)).count(text) == whole
    assert BpeCounter.for_model("gpt-4", str(tmp_path)).count(text) == int(len(text.split()) * 1.3)  # no file of that encoding


def test_settings_name_models(spark, tmp_path, monkeypatch):
    """The builder's embedder and counter are those of the settings; the library is only asked when used."""
    import types

    from passagemill.errors import EmbeddingError

    class Loaded:
        def __init__(self, name, device=None):
            self.made = (name, device)

        def get_sentence_embedding_dimension(self):
            return 3

        def encode(self, texts, batch_size, show_progress_bar):
            return [[len(t), 1.0, batch_size] for t in texts]

    made = Chunker.builder(spark).config(Config(embedding_model="some", embedding_device="cpu", token_model="gpt-4o")).neural().tokens(str(tmp_path)).build()
    assert made.counter.path.endswith("o200k_base.tiktoken")
    with pytest.raises(EmbeddingError):
        made.embedder.embed(["no library here"])
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Loaded))
    assert made.embedder.embed(["ab", "c"]).tolist() == [[2, 1, 32], [1, 1, 32]] and made.embedder.dim == 3
    assert made.embedder._loaded.made == ("some", "cpu") and made.embedder.embed([]).shape == (0, 3)
    assert made.embedder.__getstate__()["_loaded"] is None


def test_plain_front_matter_is_yaml():
    import yaml
    from passagemill import sinks

    texts = ["", "Plain words.", "It's (so)?", "Äö ü", "yes", "Null", "on", "a: b", "a #b", "a ", "- a", "7", "x\ny", "一", "a-", '"q"', "null.", "y"]
    for text in texts:
        for listed in ([], [text], ["ok", text]):
            m = {"chunk_id": "chunk_001", "title": text, "summary": "", "intent": "unknown", "questions": listed, "keywords": list(listed), "parent_section": text, "token_count": 7}
            body = yaml.dump(m, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=False, allow_unicode=True, default_flow_style=False, width=10**9)
            assert sinks.front_matter(m) == "---\n" + body + "---\n"
            assert sinks.parse_rendered(sinks.render([{"chunk_ord": 0, "metadata": m, "content": "c"}])) == [{"metadata": m, "content": "c"}]
            assert sinks._read_plain(body) in (m, None)
    assert sinks._read_plain(body.replace("title: y", "title: yes")) is None


def test_markdown_is_made_and_read_in_pieces(monkeypatch):
    import pandas as pd
    from passagemill import sinks

    rows = pd.Series(["a" * 40, None, "b" * 70, "c" * 200, "d"])
    monkeypatch.setattr(sinks, "PIECE_SIZE", 100)
    pieces = list(sinks._pieces(rows))
    assert [len(p) for p in pieces] == [3, 1, 1] and pd.concat(pieces).equals(rows)
    assert list(sinks._pieces(rows[:0])) == []


def test_embedded_cosine_at_the_threshold(spark):
    """Counts with squared lengths 50 and 200 and a product of 47: the cosine is 0.47, not below it."""
    from passagemill.providers import HashEmbedder

    place = {int(HashEmbedder(64).embed([w])[0].argmax()): w for w in (f"w{i}" for i in range(2000))}
    a, b = [7, 1, 0, 0, 0, 0, 0, 0], [6, 5, 11, 3, 2, 2, 1, 0]
    assert (sum(x * x for x in a), sum(x * x for x in b), sum(x * y for x, y in zip(a, b))) == (50, 200, 47)
    texts = [" ".join(w for k, n in enumerate(v) for w in [place[k]] * n) for v in (a, b)] * 3
    pipeline = Pipeline(Context(Config(similarity_threshold=0.47, atomize_sentences_per_paragraph=0), embedder=HashEmbedder(64)))
    found = pipeline.run(from_texts(spark, ["\n\n".join(texts)])).documents.select("similarities", "proposals").first()
    assert found["similarities"] == [0.47] * 5 and found["proposals"] == []
