"""A query for each operator over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .config import Config
from .functions import keywords as K
from .functions import text as X
from .functions import vectors as V
from .operators import boundaries as B
from .operators import chunks as C
from .operators import paragraphs as P
from .operators import planner as G
from .plans.pipeline import Chunker, Pipeline
from .plans.stages import Context
from .sources import registry as R

THRESHOLD = 0.3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def atoms(spark: SparkSession, sf_dir: str, gs: int = 2, ms: int = 6) -> DataFrame:
    """Documents with the column ``atoms``."""
    parsed = docs(spark, sf_dir).select("doc_id", P.plain(X.text_paragraphs(F.col("text"))).alias("paragraphs"))
    return parsed.select("doc_id", X.barrier(P.atomize(F.col("paragraphs"), F.lit(gs), F.lit(ms))).alias("atoms"))


def chunker(spark: SparkSession) -> Chunker:
    return Chunker(spark, Config(similarity_threshold=THRESHOLD))


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# SQL pieces. DuckDB's expressions have no look-behind: sentence ends are marked, then split.
_WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{_WS}+', ' ', 'g')"


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _words(x: str) -> str:
    return f"list_filter(string_split({_collapse(x)}, ' '), lambda w: w <> '')"


def _paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), chr(10) || chr(10)), lambda p: {_collapse('p')}), lambda p: p <> '')"


_DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"


def _atom_ctes(gs: int = 2, ms: int = 6) -> str:
    """CTEs ``para`` (doc_id, p0, t), ``atom`` (doc_id, idx, text, src)."""
    return f"""
para AS (SELECT doc_id, unnest(range(len(ps))) AS p0, unnest(ps) AS t FROM (SELECT doc_id, {_paragraphs("text")} AS ps FROM documents)),
sent AS (SELECT doc_id, p0, t, {_sentences("t")} AS ss FROM para),
cut AS (SELECT doc_id, p0, CASE WHEN len(ss) < {max(ms, gs + 1)} THEN [{_strip("t")}]
        ELSE list_transform(range(0, len(ss) // {gs}), lambda i: array_to_string(ss[i * {gs} + 1 : CASE WHEN i = len(ss) // {gs} - 1 THEN len(ss) ELSE (i + 1) * {gs} END], ' ')) END AS xs FROM sent),
flat AS (SELECT doc_id, p0, unnest(range(len(xs))) AS k, unnest(xs) AS text FROM cut),
atom AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p0, k) - 1 AS idx, text, p0 AS src FROM flat)"""


#: CTEs from ``atom`` on: word counts, neighbours' similarity, documents that are not short.
_SIM_CTES = f"""
tok AS (SELECT doc_id, idx, w, count(*) AS n FROM (SELECT doc_id, idx, unnest({_words("lower(text)")}) AS w FROM atom) GROUP BY ALL),
norm AS (SELECT doc_id, idx, sum(n * n) AS q FROM tok GROUP BY ALL),
dot AS (SELECT a.doc_id, a.idx, sum(a.n * b.n) AS d FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.w = b.w AND b.idx = a.idx + 1 GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM atom GROUP BY doc_id),
sim AS (SELECT a.doc_id, a.idx + 1 AS position, coalesce(d.d::DOUBLE / sqrt((x.q * y.q)::DOUBLE), 0.0) AS similarity
        FROM atom a JOIN size s ON a.doc_id = s.doc_id AND s.n >= 5 AND a.idx < s.n - 1
        LEFT JOIN dot d ON d.doc_id = a.doc_id AND d.idx = a.idx
        LEFT JOIN norm x ON x.doc_id = a.doc_id AND x.idx = a.idx LEFT JOIN norm y ON y.doc_id = a.doc_id AND y.idx = a.idx + 1)"""
_CHUNK_CTES = f"""
mark AS (SELECT a.doc_id, a.idx, a.text, a.src, CASE WHEN s.similarity < {THRESHOLD} THEN 1 ELSE 0 END AS b
         FROM atom a LEFT JOIN sim s ON s.doc_id = a.doc_id AND s.position = a.idx),
run AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY idx) AS chunk_ord FROM mark),
chunk AS (SELECT doc_id, chunk_ord::BIGINT AS chunk_ord, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS content, string_agg(src::VARCHAR, ',' ORDER BY idx) AS sources FROM run GROUP BY ALL)"""


@query(f"SELECT doc_id, unnest(range(len(ps)))::BIGINT AS idx, unnest(ps) AS text FROM (SELECT doc_id, {_paragraphs(_DOUBLED)} AS ps FROM documents)")
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.text_paragraphs(doubled)).alias("idx", "text")).select("doc_id", long("idx").alias("idx"), "text")


@query(f"""
WITH t AS (SELECT conv_id, turn, {_collapse("coalesce(text, '')")} AS text FROM conversations)
SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS idx, text,
       count(*) OVER (PARTITION BY conv_id) < 5 AS short FROM t WHERE text <> ''""")
def text_paragraphs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = R.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    few = F.size("parsed.paragraphs") < Config().short_document_threshold
    return parsed.select("doc_id", few.alias("short"), F.inline("parsed.paragraphs")).select("doc_id", long("idx").alias("idx"), "text", "short")


@query(f"SELECT doc_id, len({_sentences('text')})::BIGINT AS sentences FROM documents")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", long(X.sentence_count(F.col("text"))).alias("sentences"))


def _flat_atoms(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.inline("atoms")).select("doc_id", long("idx").alias("idx"), "text", long("source_idx").alias("source_idx"))


@query(f"WITH {_atom_ctes()} SELECT doc_id, idx::BIGINT AS idx, text, src::BIGINT AS source_idx FROM atom")
def atomize_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_atoms(atoms(spark, sf_dir))


@query(f"WITH {_atom_ctes(3, 4)} SELECT doc_id, idx::BIGINT AS idx, text, src::BIGINT AS source_idx FROM atom")
def atomize_gs3_ms4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_atoms(atoms(spark, sf_dir, 3, 4))


@query(f"""
SELECT doc_id, (CASE WHEN n < 6 THEN 1 ELSE greatest(1, n // 2) END)::BIGINT AS gs2_ms6, (CASE WHEN n < 4 THEN 1 ELSE greatest(1, n // 3) END)::BIGINT AS gs3_ms0
FROM (SELECT doc_id, len({_sentences("text")}) AS n FROM documents WHERE {_strip("text")} <> '')""")
def estimate_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = docs(spark, sf_dir).where(X.strip(F.col("text")) != "").select("doc_id", P.sentence_counts(P.plain(X.text_paragraphs(F.col("text")))).alias("n"))
    made = lambda gs, ms: long(P.estimate_atoms(F.col("n"), F.lit(gs), F.lit(ms)))
    return counted.select("doc_id", made(2, 6).alias("gs2_ms6"), made(3, 0).alias("gs3_ms0"))


@query(f"""
WITH {_atom_ctes()}
SELECT d.doc_id, (SELECT count(*) FROM para p WHERE p.doc_id = d.doc_id)::BIGINT AS paragraphs, (SELECT count(*) FROM atom a WHERE a.doc_id = d.doc_id)::BIGINT AS atoms,
       (SELECT count(*) FROM para p WHERE p.doc_id = d.doc_id) < 5 AND (SELECT count(*) FROM atom a WHERE a.doc_id = d.doc_id) < 5 AS short
FROM documents d""")
def short_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = chunker(spark).chunk_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), dry_run=True).documents
    return run.select("doc_id", long("paragraphs_before_atomize").alias("paragraphs"), long(F.size("paragraphs")).alias("atoms"), "short")


_VEC = "lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)"


@query(f"""
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, ({_VEC})::DOUBLE[] AS u FROM embeddings)
SELECT vec_id, label, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 9) + 0.0 AS similarity FROM p WHERE u IS NOT NULL""")
def adjacent_similarity_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    return pairs.select("vec_id", "label", (F.round(V.cosine(F.col("before"), F.col("embedding")), 9) + 0.0).alias("similarity"))


def similarities(spark: SparkSession, sf_dir: str, enriched: bool = False) -> DataFrame:
    """A run over all documents, by default up to bare chunks."""
    made = chunker(spark)
    pipeline = Pipeline(Context(made.config))
    if not enriched:
        pipeline.remove("enrich")
    result = pipeline.run(R.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    if result.errors:
        raise RuntimeError("; ".join(result.errors))
    return result.documents


@query(f"WITH {_atom_ctes()}, {_SIM_CTES} SELECT doc_id, position::BIGINT AS position, similarity FROM sim")
def adjacent_similarity_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).select("doc_id", F.posexplode("similarities").alias("i", "similarity")).select("doc_id", (long("i") + 1).alias("position"), "similarity")


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}
SELECT doc_id, round(avg(similarity), 9) AS mean, round(stddev_pop(similarity), 9) AS std, min(similarity) AS min, max(similarity) AS max,
       count(*)::BIGINT AS count, round(quantile_cont(similarity, 0.5), 9) AS median FROM sim GROUP BY doc_id""")
def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarities(spark, sf_dir).where(F.size("similarities") > 0).select("doc_id", V.statistics(F.col("similarities")).alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", *[F.round(c, 9).alias(c) for c in ("mean", "std")], "min", "max", "count", F.round("median", 9).alias("median"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}
SELECT d.doc_id, round(coalesce((SELECT quantile_cont(similarity, 0.25) FROM sim WHERE sim.doc_id = d.doc_id), 0.5), 9) AS threshold FROM documents d""")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).select("doc_id", F.round(V.adaptive_threshold(F.col("similarities")), 9).alias("threshold"))


@query(f"WITH {_atom_ctes()}, {_SIM_CTES} SELECT doc_id, position::BIGINT AS position, similarity FROM sim WHERE similarity < {THRESHOLD}")
def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).select("doc_id", F.inline(V.candidates(F.col("similarities"), THRESHOLD))).select("doc_id", long("position").alias("position"), "similarity")


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}
SELECT s.doc_id, s.position::BIGINT AS position,
       CASE WHEN length(a.text) > 60 THEN '...' || right(a.text, 60) ELSE a.text END AS before, CASE WHEN length(b.text) > 60 THEN left(b.text, 60) || '...' ELSE b.text END AS after
FROM sim s JOIN atom a ON a.doc_id = s.doc_id AND a.idx = s.position - 1 JOIN atom b ON b.doc_id = s.doc_id AND b.idx = s.position WHERE s.similarity < {THRESHOLD}""")
def boundary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarities(spark, sf_dir).select("doc_id", F.inline(F.arrays_zip(F.col("proposals"), B.previews(F.col("proposals"), 60).alias("shown"))))
    return found.select("doc_id", long("proposals.position").alias("position"), "shown.before", "shown.after")


_VERDICT = "CASE vec_id % 7 WHEN 0 THEN 'merge' WHEN 1 THEN ' MERGE' WHEN 2 THEN 'maybe' WHEN 3 THEN 'Adjust' WHEN 4 THEN 'KEEP' WHEN 5 THEN '' END"


@query(f"SELECT vec_id, CASE WHEN upper(v) IN ('KEEP', 'MERGE', 'ADJUST') THEN upper(v) ELSE 'KEEP' END AS verdict FROM (SELECT vec_id, {_VERDICT} AS v FROM embeddings)")
def verdict_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", K.verdict(F.expr(_VERDICT)).alias("verdict"))


_RULE = "CASE WHEN length(b.text) < 40 THEN 'MERGE' WHEN contains(b.text, '!') THEN 'ADJUST' ELSE 'KEEP' END"


def _rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule in place of a model: short paragraphs merge, exclamations are adjusted."""

    def answer(p: Column) -> Column:
        rule = F.when(F.length(p["text_after"]) < 40, "MERGE").when(F.contains(p["text_after"], F.lit("!")), "ADJUST").otherwise("KEEP")
        return F.struct(F.lit(True).alias("ok"), rule.alias("verdict"), F.lit("rule").alias("reason"), F.lit(0.9).alias("confidence"))

    found = similarities(spark, sf_dir)
    return found.withColumn("decisions", B.decide(F.col("proposals"), F.transform("proposals", answer)))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}
SELECT s.doc_id, s.position::BIGINT AS position, {_RULE} AS verdict, CASE WHEN {_RULE} = 'MERGE' THEN -1 ELSE s.position END::BIGINT AS final_position
FROM sim s JOIN atom b ON b.doc_id = s.doc_id AND b.idx = s.position WHERE s.similarity < {THRESHOLD}""")
def validated_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform("decisions", lambda d: F.struct(d["position"].cast("long").alias("position"), d["verdict"].alias("verdict"), F.coalesce(B.final_position(d), F.lit(-1)).cast("long").alias("final_position")))
    return _rule_decisions(spark, sf_dir).select("doc_id", F.inline(each))


def _flat_chunks(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.inline("chunks"))


@query(f"WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES} SELECT doc_id, chunk_ord, content FROM chunk")
def form_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(similarities(spark, sf_dir)).select("doc_id", long("chunk_ord").alias("chunk_ord"), "content")


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES},
mark AS (SELECT a.doc_id, a.idx, CASE WHEN s.similarity < {THRESHOLD} AND (CASE WHEN length(a.text) < 40 THEN 'MERGE' ELSE 'KEEP' END) <> 'MERGE' THEN 1 ELSE 0 END AS b
         FROM atom a LEFT JOIN sim s ON s.doc_id = a.doc_id AND s.position = a.idx),
run AS (SELECT doc_id, idx, sum(b) OVER (PARTITION BY doc_id ORDER BY idx) AS chunk_ord FROM mark)
SELECT doc_id, chunk_ord::BIGINT AS chunk_ord, min(idx)::BIGINT AS first, count(*)::BIGINT AS paragraphs FROM run GROUP BY ALL""")
def form_chunks_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _rule_decisions(spark, sf_dir)
    unsourced = F.transform("paragraphs", lambda p: p.withField("source_idx", F.lit(None).cast("int")))
    made = decided.select("doc_id", F.inline(C.form_chunks(unsourced, B.split_positions(F.col("decisions")))))
    return made.select("doc_id", long("chunk_ord").alias("chunk_ord"), long(F.col("source_paragraphs")[0]).alias("first"), long(F.size("source_paragraphs")).alias("paragraphs"))


@query(f"WITH {_atom_ctes()} SELECT doc_id, 0::BIGINT AS chunk_ord, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS content, true AS bare FROM atom GROUP BY doc_id")
def form_chunks_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _flat_chunks(chunker(spark).chunk_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), dry_run=True).documents)
    return made.select("doc_id", long("chunk_ord").alias("chunk_ord"), "content", F.col("metadata").isNull().alias("bare"))


@query(f"WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES} SELECT doc_id, chunk_ord, sources FROM chunk")
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(similarities(spark, sf_dir)).select("doc_id", long("chunk_ord").alias("chunk_ord"), F.array_join("source_paragraphs", ",").alias("sources"))


@query(r"""
WITH b AS (SELECT page_id, regexp_extract_all(html, '<(h1|p)>([^<]+)', 1) AS kinds, regexp_extract_all(html, '<(h1|p)>([^<]+)', 2) AS texts FROM pages),
f AS (SELECT page_id, unnest(range(len(kinds))) AS i, unnest(kinds) AS kind, unnest(texts) AS text FROM b),
s AS (SELECT *, last_value(CASE WHEN kind = 'h1' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM f)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS idx, text, coalesce(section, '') AS section FROM s WHERE kind = 'p'""")
def parent_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.markdown import outline

    pattern = F.lit("<(h1|p)>([^<]+)")
    found = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("k"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))
    blocks = F.transform(found, lambda b: F.struct(F.when(b["k"] == "h1", "heading").otherwise("paragraph").alias("kind"), F.when(b["k"] == "h1", 1).otherwise(0).alias("level"), b["t"].alias("text"), F.lit(None).cast("string").alias("language")))
    parsed = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", outline(blocks).alias("d"))
    return parsed.select("page_id", F.inline("d.paragraphs")).select("page_id", long("idx").alias("idx"), "text", "section")


_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_KEYWORDS = rf"""
kw0 AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, list_transform({_words("lower(text)")}, lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')) AS ws FROM documents)),
kw1 AS (SELECT doc_id, w, count(*) AS n, min(i) AS first FROM kw0 WHERE length(w) > 3 AND w NOT IN ({_STOP}) GROUP BY ALL),
kw AS (SELECT doc_id, list(w ORDER BY n DESC, first)[1:5] AS ks FROM kw1 GROUP BY doc_id)"""


@query(f"WITH {_KEYWORDS} SELECT d.doc_id, coalesce(array_to_string(ks, ','), '') AS keywords FROM documents d LEFT JOIN kw USING (doc_id)")
def fallback_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(K.simple_keywords(F.col("text")), ",").alias("keywords"))


@query("""
SELECT doc_id, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title FROM (SELECT doc_id, string_split(text, '. ')[1] AS t FROM documents)""")
def fallback_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", K.fallback_title(F.col("text")).alias("title"))


@query(f"""
WITH {_KEYWORDS}
SELECT d.doc_id, CASE WHEN len(ks) IS NULL THEN '' WHEN len(ks) = 1 THEN 'What is ' || ks[1] || '?'
  ELSE 'What is ' || ks[1] || '?|How does ' || ks[1] || ' relate to ' || array_to_string(ks[2:4], ', ') || '?|Explain ' || ks[2] || '.?' END AS questions
FROM documents d LEFT JOIN kw USING (doc_id)""")
def fallback_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = X.let(K.simple_keywords(F.col("text")), K.fallback_questions)
    return docs(spark, sf_dir).select("doc_id", F.array_join(asked, "|").alias("questions"))


@query(f"""
WITH g AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda w: {_strip("w")}), lambda w: w <> '') AS ws FROM documents),
f AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM g),
u AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM f GROUP BY doc_id, lower(w))
SELECT d.doc_id, coalesce(array_to_string((SELECT list(w ORDER BY i)[1:12] FROM u WHERE u.doc_id = d.doc_id), ','), '') AS keywords FROM documents d""")
def keyword_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(K.normalise_keywords(F.split("text", " ", -1)), ",").alias("keywords"))


@query(f"""
WITH {_KEYWORDS},
q AS (SELECT d.doc_id, coalesce(ks, []) AS ks, ['What of ' || coalesce(ks[1], 'it') || '?'] AS qs FROM documents d LEFT JOIN kw USING (doc_id)),
m AS (SELECT *, list_filter(ks, lambda k: NOT contains(lower(qs[1]), lower(k))) AS missing FROM q)
SELECT doc_id, CASE WHEN len(missing) > greatest(1, len(ks) // 3) THEN qs[1] || '|' || array_to_string(list_transform(missing, lambda k: 'Explain ' || k || '?'), '|') ELSE qs[1] END AS questions FROM m""")
def question_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = lambda ks: K.cover_keywords(F.array(F.concat(F.lit("What of "), F.coalesce(F.get(ks, F.lit(0)), F.lit("it")), F.lit("?"))), ks)
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.let(K.simple_keywords(F.col("text")), asked), "|").alias("questions"))


@query(f"SELECT doc_id, trunc(len({_words('text')}) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", long(X.approx_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_words('text')}[1:{int(20 / 1.3)}], ' ') AS text FROM documents")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.truncate_words(F.col("text"), 20).alias("text"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT doc_id, chunk_ord, 'chunk_' || lpad((chunk_ord + 1)::VARCHAR, greatest(3, length((chunk_ord + 1)::VARCHAR))::INTEGER, '0') AS chunk_id,
       CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title, 'unknown' AS intent, trunc(len({_words("content")}) * 1.3::DOUBLE)::BIGINT AS token_count
FROM (SELECT *, string_split(content, '. ')[1] AS t FROM chunk)""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "metadata"
    return _flat_chunks(similarities(spark, sf_dir, True)).select("doc_id", long("chunk_ord").alias("chunk_ord"), f"{m}.chunk_id", f"{m}.title", f"{m}.intent", long(f"{m}.token_count").alias("token_count"))


@query(f"""
WITH {_atom_ctes()},
n AS (SELECT doc_id, count(*) AS n FROM atom GROUP BY doc_id),
m AS (SELECT doc_id, n, greatest(n // 2 - 1, 3) AS s FROM n),
r AS (SELECT a.doc_id, a.idx, a.text, m.n FROM atom a JOIN m USING (doc_id) WHERE m.n <= 9 OR a.idx < 3 OR a.idx >= m.n - 3 OR (a.idx >= m.s AND a.idx < least(m.s + 3, m.n - 3)))
SELECT doc_id, string_agg('- P' || idx || ' sentences=' || len({_sentences("text")}) || ' chars=' || length(text) || ': ' ||
         CASE WHEN length(text) > 40 THEN regexp_replace(left(text, 40), '{_WS}+\\z', '') || '...' ELSE text END, chr(10) ORDER BY idx)
       || CASE WHEN max(n) > 9 THEN chr(10) || '- ... (sampled ' || count(*) || '/' || max(n) || ' paragraphs)' ELSE '' END AS lines
FROM r GROUP BY doc_id""")
def paragraph_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).where(F.size("atoms") > 0).select("doc_id", G.paragraph_lines(F.col("atoms"), 9, 40).alias("lines"))


_REPLY = """'{"expected_chunk_count": ' || (vec_id % 13 - 1) || ', "expected_chunk_count_range": [' || (vec_id % 9) || ', ' || (vec_id % 5 + 1) || '.5], "atomize_sentences_per_paragraph": "' || (vec_id % 14 - 2) || '", "confidence": ' || (vec_id % 4) || ', "topics": "a, b"}'"""


@query("""
WITH r AS (SELECT vec_id, greatest(1, least(100000, vec_id % 13 - 1)) AS e, greatest(1, vec_id % 9) AS a, greatest(1, round_even(vec_id % 5 + 1.5, 0)) AS b FROM embeddings)
SELECT vec_id, e::BIGINT AS expected, least(a, b)::BIGINT AS lo, greatest(a, b)::BIGINT AS hi, greatest(0, least(10, vec_id % 14 - 2))::BIGINT AS gs, 6::BIGINT AS ms,
       least(1.0, vec_id % 4)::DOUBLE AS confidence, 'a|b' AS topics FROM r""")
def plan_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = rows.select("vec_id", G.normalise_plan(F.expr(_REPLY), F.lit(7), 6).alias("p"))
    return plan.select("vec_id", *[long(f"p.{c}").alias(c) for c in ("expected", "lo", "hi", "gs", "ms")], "p.confidence", F.array_join("p.topics", "|").alias("topics"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM atom)::BIGINT AS atoms,
       (SELECT count(*) FROM sim WHERE similarity < {THRESHOLD})::BIGINT AS proposals, (SELECT count(*) FROM chunk)::BIGINT AS chunks""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = similarities(spark, sf_dir).select(F.size("paragraphs").alias("a"), F.size("proposals").alias("p"), F.size("chunks").alias("c"))
    return d.agg(F.count("*").alias("documents"), F.sum("a").alias("atoms"), F.sum("p").alias("proposals"), F.sum("c").alias("chunks"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT doc_id, count(*)::BIGINT AS chunks, sum(trunc(len({_words("content")}) * 1.3::DOUBLE))::BIGINT AS tokens FROM chunk GROUP BY doc_id""")
def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["metadata"]["token_count"])
    return similarities(spark, sf_dir, True).where(F.size("chunks") > 0).select("doc_id", long(F.size("chunks")).alias("chunks"), tokens.alias("tokens"))


@query(f"""
WITH {_atom_ctes()},
n AS (SELECT d.doc_id, (SELECT count(*) FROM para p WHERE p.doc_id = d.doc_id) AS p, (SELECT count(*) FROM atom a WHERE a.doc_id = d.doc_id) AS a FROM documents d)
SELECT doc_id, 'segment' AS stage, 'short document: ' || p || ' paragraphs' AS message FROM n WHERE p < 5
UNION ALL SELECT doc_id, 'segment', 'document has no paragraphs' FROM n WHERE p = 0
UNION ALL SELECT doc_id, 'atomize', 'atomized document is no longer short' FROM n WHERE p < 5 AND a >= 5""")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).select("doc_id", F.inline("events")).select("doc_id", "stage", "message")


@query(r"""
WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<(?:h1|li)>(?:<a [^>]*>)?([^<]+)', 1), lambda x: trim(x)), lambda x: x <> '') AS ts FROM pages)
SELECT page_id, '[' || array_to_string(list_transform(ts[1:4], lambda x: '"' || x || '"'), ', ') || CASE WHEN len(ts) > 4 THEN ', ...' ELSE '' END || ']' AS titles FROM t""")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.regexp_extract_all("html", F.lit("<(?:h1|li)>(?:<a [^>]*>)?([^<]+)"), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", G.title_list(titles, 4).alias("titles"))


_ANSWER = """CASE vec_id % 5 WHEN 0 THEN '{"verdict": "merge", "confidence": 0.25}' WHEN 1 THEN '```json' || chr(10) || '{"verdict": "ADJUST", "reason": "r"}' || chr(10) || '```'
  WHEN 2 THEN 'not json' WHEN 3 THEN '["KEEP"]' ELSE ' {"reason": "only"} ' END"""


@query("""
SELECT vec_id, k IN (0, 1, 4) AS ok, CASE k WHEN 0 THEN 'MERGE' WHEN 1 THEN 'ADJUST' ELSE 'KEEP' END AS verdict,
       CASE k WHEN 0 THEN '' WHEN 1 THEN 'r' WHEN 4 THEN 'only' ELSE 'LLM validation failed, defaulting to KEEP' END AS reason,
       CASE k WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 4 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence
FROM (SELECT vec_id, vec_id % 5 AS k FROM embeddings)""")
def reply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.replies import boundary_answer

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.array(boundary_answer(F.expr(_ANSWER.replace("chr(10)", "char(10)")))).alias("a"))
    proposal = F.array(F.struct(F.lit(1).alias("position"), F.lit(0.1).alias("similarity"), F.lit("a").alias("text_before"), F.lit("b").alias("text_after")))
    decided = rows.select("vec_id", F.col("a")[0]["ok"].alias("ok"), B.decide(proposal, F.col("a"))[0].alias("d"))
    return decided.select("vec_id", "ok", "d.verdict", "d.reason", "d.confidence")


@query("""
SELECT p_partkey, CASE WHEN s >= 14 AND n <= 10 THEN 1 WHEN s >= 12 AND b AND n <= 10 THEN 2 WHEN b AND n <= 10 AND right(t, 1) NOT IN ('.', ',', ';', ':') THEN 3 ELSE 0 END::BIGINT AS level
FROM (SELECT p_partkey, p_size / 2.5 AS s, p_partkey % 3 = 0 AS b, repeat(p_name || ' ', (p_partkey % 7 + 1)::INTEGER) || CASE WHEN p_partkey % 5 = 0 THEN 'x.' ELSE 'x' END AS t,
             (len(string_split(p_name, ' ')) * (p_partkey % 7 + 1) + 1) AS n FROM part)""")
def pdf_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.pdf import heading_level

    text = "repeat(p_name || ' ', int(p_partkey % 7 + 1)) || CASE WHEN p_partkey % 5 = 0 THEN 'x.' ELSE 'x' END AS text"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"struct({text}, p_size / 2.5D AS avg_size, p_partkey % 3 = 0 AS bold) AS b")
    return rows.select("p_partkey", long(F.coalesce(heading_level(F.col("b")), F.lit(0))).alias("level"))


@query("""
WITH h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord, 1 + l_partkey % 4 AS level FROM lineitem)
SELECT a.l_orderkey AS doc_id, a.ord::BIGINT AS section_ord, a.level::BIGINT AS level,
       coalesce((SELECT max(b.ord) FROM h b WHERE b.l_orderkey = a.l_orderkey AND b.ord < a.ord AND b.level < a.level), -1)::BIGINT AS parent_ord
FROM h a""")
def section_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.markdown import outline

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keyed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    heads = F.transform(keyed, lambda x: F.struct(F.lit("heading").alias("kind"), (x["l_partkey"] % 4 + 1).cast("int").alias("level"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("language")))
    parsed = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(outline(heads).alias("d"))
    return parsed.select("doc_id", F.inline("d.sections")).select("doc_id", long("section_ord").alias("section_ord"), long("level").alias("level"), F.coalesce(long("parent_ord"), F.lit(-1)).alias("parent_ord"))


@query("SELECT doc_id, 'chunk_' || doc_id AS chunk_id, left(text, 10) AS title, '' AS summary, 'unknown' AS intent, 0::BIGINT AS keywords, 7::BIGINT AS token_count FROM documents")
def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sinks import metadata_from_json

    text = F.to_json(F.struct(F.concat(F.lit("chunk_"), F.col("doc_id")).alias("chunk_id"), F.left("text", F.lit(10)).alias("title"), F.lit(7).alias("token_count")))
    back = docs(spark, sf_dir).select("doc_id", metadata_from_json(text).alias("m"))
    return back.select("doc_id", "m.chunk_id", "m.title", "m.summary", "m.intent", long(F.size("m.keywords")).alias("keywords"), long("m.token_count").alias("token_count"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}
SELECT s.doc_id, s.position::BIGINT AS position, 'END OF CHUNK:' || chr(10) || a.text || chr(10) || chr(10) || 'START OF NEW CHUNK:' || chr(10) || b.text AS context
FROM sim s JOIN atom a ON a.doc_id = s.doc_id AND a.idx = s.position - 1 JOIN atom b ON b.doc_id = s.doc_id AND b.idx = s.position WHERE s.similarity < {THRESHOLD}""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarities(spark, sf_dir).select("doc_id", F.inline("proposals"))
    return found.select("doc_id", long("position").alias("position"), X.context_text(F.col("text_before"), F.col("text_after")).alias("context"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT doc_id, chunk_ord, length(content)::BIGINT AS length, true AS enriched FROM chunk""")
def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _flat_chunks(similarities(spark, sf_dir, True))
    return made.select("doc_id", long("chunk_ord").alias("chunk_ord"), long(F.length("content")).alias("length"), F.col("metadata").isNotNull().alias("enriched"))


_INTENT = "CASE vec_id % 5 WHEN 0 THEN 'Warns' WHEN 1 THEN 'LISTS' WHEN 2 THEN ' lists' WHEN 3 THEN 'explain' END"


@query("SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'warns' WHEN 1 THEN 'lists' ELSE 'unknown' END AS intent FROM embeddings")
def intent_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", K.intent(F.expr(_INTENT)).alias("intent"))


_DESCRIBED = """CASE vec_id % 3 WHEN 0 THEN '{"title": "T' || vec_id || '", "intent": "DEFINES", "questions": ["why", "Why?", " "], "keywords": "aa, bb,, AA"}'
  WHEN 1 THEN '{"questions": "- one' || '\\\\n' || '- two?", "keywords": ["one"]}' ELSE 'no json' END"""


@query("""
SELECT vec_id, CASE k WHEN 0 THEN 'T' || vec_id WHEN 1 THEN 'Untitled' ELSE 'Alpha beta gamma' END AS title, CASE k WHEN 2 THEN 'Content summary unavailable' ELSE '' END AS summary,
       CASE k WHEN 0 THEN 'defines' ELSE 'unknown' END AS intent,
       CASE k WHEN 0 THEN 'why?|Explain aa?|Explain bb?' WHEN 1 THEN 'one?|two?' ELSE 'What is alpha?|How does alpha relate to beta, gamma?|Explain beta.?' END AS questions,
       CASE k WHEN 0 THEN 'aa|bb' WHEN 1 THEN 'one' ELSE 'alpha|beta|gamma' END AS keywords
FROM (SELECT vec_id, vec_id % 3 AS k FROM embeddings)""")
def reply_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.replies import chunk_answer

    chunk = F.array(F.struct(F.lit(0).alias("chunk_ord"), F.lit("Alpha beta gamma").alias("content"), F.array(F.lit(0)).alias("source_paragraphs"), F.lit("s").alias("parent_section"), F.lit(None).cast("string").alias("metadata")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.array(chunk_answer(F.expr(_DESCRIBED))).alias("a"))
    made = rows.select("vec_id", C.enrich(chunk, F.col("a"))[0]["metadata"].alias("m"))
    return made.select("vec_id", "m.title", "m.summary", "m.intent", F.array_join("m.questions", "|").alias("questions"), F.array_join("m.keywords", "|").alias("keywords"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents with their metadata."""
    return _flat_chunks(similarities(spark, sf_dir, True))
