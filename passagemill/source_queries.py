"""Queries for sources, sinks, planning and models, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import Config
from .functions import prompts
from .functions import text as X
from .functions import vectors as V
from .operators import boundaries as B
from .operators import paragraphs as P
from .operators import planner as G
from .plans.pipeline import Chunker, Pipeline
from .plans.stages import Context
from .providers import FixedModel, HashEmbedder
from .queries import _CHUNK_CTES, _SIM_CTES, _atom_ctes, _paragraphs, _sentences, _words, THRESHOLD, docs, long, query, similarities
from .sources import markdown, pdf
from .sources import registry as R

# Markdown with every kind of block, made of a part's key and name; the expected blocks are known by construction.
_NL, _K = "'\n'", "cast(p_partkey AS string)"
_MD = " || ".join(
    x
    for part in [
        ["'Lead '", _K, "'.\n\n'"],
        ["repeat('#', cast(p_partkey % 6 + 1 AS int))", "' '", "p_name", "'\n'"],
        ["'Body one\ngoes on.\n\n'"],
        ["'```sql\na\tb\n\n# no '", _K, "'\n```\n'"],
        ["'- x '", _K, "'\n- y\n  more\n\n1. first\n2. second\n\n'"],
        ["'> said '", _K, "'\n> again\n\n'"],
        ["'<script>\nvar a;\n\nvar b;\n</script>\n\n<!-- no\n\nno -->\n<span>\nhtml\n\n[ref]: http://a.b/'", _K, "'\n\n***\n\n<div>\nhtml\n\n'"],
        ["'| h | i |\n|---|---|\n| '", _K, "' | 2 |\n\n'"],
        ["'\tindented\tx\n\nUnder\n---\n\nLast.'"],
    ]
    for x in part
)
_TABLE = "'| h | i |' || chr(10) || '|---|---|' || chr(10) || '| ' || k || ' | 2 |'"
_CODE, _ITEMS, _SAID = "'a' || chr(9) || 'b' || chr(10) || chr(10) || '# no ' || k", "'- x ' || k || chr(10) || '- y' || chr(10) || 'more'", "'> said ' || k || chr(10) || 'again'"
_INDENTED, _BODY, _STEPS = "'indented' || chr(9) || 'x'", "'Body one' || chr(10) || 'goes on.'", "'1. first' || chr(10) || '2. second'"
#: (kind, level, text, language) of the blocks, in SQL over a part's key ``k`` and name ``p_name``.
_BLOCKS = [
    ("paragraph", "0", "'Lead ' || k || '.'", "NULL"), ("heading", "k % 6 + 1", "p_name", "NULL"), ("paragraph", "0", _BODY, "NULL"), ("code_block", "0", _CODE, "'sql'"), ("list", "0", _ITEMS, "NULL"),
    ("list", "0", _STEPS, "NULL"), ("blockquote", "0", _SAID, "NULL"), ("table", "0", _TABLE, "NULL"), ("code_block", "0", _INDENTED, "NULL"), ("heading", "2", "'Under'", "NULL"), ("paragraph", "0", "'Last.'", "NULL"),
]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return R.spread(rows.select("p_partkey", F.expr(_MD.replace("\n", "\\n").replace("\t", "\\t")).alias("md")))


@query(" UNION ALL ".join(
    f"SELECT k AS p_partkey, {i}::BIGINT AS ord, '{kind}' AS kind, ({level})::BIGINT AS level, {text} AS text, {language}::VARCHAR AS language FROM (SELECT p_partkey AS k, p_name FROM part)"
    for i, (kind, level, text, language) in enumerate(_BLOCKS)
))
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, code, lists, quotes and tables; HTML, rules and definitions are none."""
    found = _parts(spark, sf_dir).select("p_partkey", markdown.blocks(F.col("md"), tables=True).alias("b"))
    found = found.select("p_partkey", F.posexplode("b").alias("ord", "block"))
    return found.select("p_partkey", long("ord").alias("ord"), "block.kind", long("block.level").alias("level"), "block.text", "block.language")


_HELD = [(kind, text, language) for kind, _, text, language in _BLOCKS if kind != "heading"]
_SECTION_OF = ["''", *["p_name"] * 7, "'Under'"]


@query(" UNION ALL ".join(
    f"SELECT k AS p_partkey, {i}::BIGINT AS idx, {text} AS text, '{kind}' AS element_type, {kind in ('code_block', 'table')} AS is_atomic, {language}::VARCHAR AS language, {section} AS section FROM (SELECT p_partkey AS k, p_name FROM part)"
    for i, ((kind, text, language), section) in enumerate(zip(_HELD, _SECTION_OF))
))
def markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with their kinds, sections and what must not be split."""
    found = _parts(spark, sf_dir).select("p_partkey", markdown.parse(F.col("md"), tables=True).alias("d")).select("p_partkey", F.inline("d.paragraphs"))
    return found.select("p_partkey", long("idx").alias("idx"), "text", "element_type", "is_atomic", "language", "section")


@query("""
SELECT p_partkey, 0::BIGINT AS section_ord, '' AS title, 0::BIGINT AS level, -1::BIGINT AS parent_ord FROM part
UNION ALL SELECT p_partkey, 1, p_name, p_partkey % 6 + 1, -1 FROM part
UNION ALL SELECT p_partkey, 2, 'Under', 2, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE -1 END FROM part""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The implicit section and the headings, each under the last that is less deep."""
    found = _parts(spark, sf_dir).select("p_partkey", markdown.parse(F.col("md")).alias("d")).select("p_partkey", F.inline("d.sections"))
    return found.select("p_partkey", long("section_ord").alias("section_ord"), "title", long("level").alias("level"), F.coalesce(long("parent_ord"), F.lit(-1)).alias("parent_ord"))


def _joined(*texts: str) -> str:
    return " || chr(10) || chr(10) || ".join(f"({t})" for t in texts)


@query(" UNION ALL ".join(
    f"SELECT k AS doc_id, {i}::BIGINT AS chunk_ord, {content} AS content, '{sources}' AS sources, {section} AS section FROM (SELECT p_partkey AS k, p_name FROM part)"
    for i, (content, sources, section) in enumerate([
        ("'Lead ' || k || '.'", "0", "''"), (_joined(_BODY, _CODE, _ITEMS, _STEPS, _SAID), "1,2,3,4,5", "p_name"), (_joined(_TABLE, _INDENTED), "6,7", "p_name"), ("'Last.'", "8", "'Under'"),
    ])
))
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of Markdown: boundaries leap over what is not a paragraph, which stays with the chunk before, and a chunk has its first paragraph's section."""
    documents = R.from_table(_parts(spark, sf_dir), "p_partkey", "md", lambda c: markdown.parse(c), "markdown")
    made = Pipeline(Context(Config(similarity_threshold=THRESHOLD))).run(documents).chunks
    return made.select("doc_id", long("chunk_ord").alias("chunk_ord"), "content", F.array_join("source_paragraphs", ",").alias("sources"), F.col("metadata.parent_section").alias("section"))


# Spans of a PDF made of an order's lines: a block of two lines and three spans for each.
_LINES = """
l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS b, l_partkey AS p, l_suppkey AS s FROM lineitem),
blk AS (SELECT doc_id, b, 'P' || p || ' S' || s || CASE WHEN p % 4 = 0 THEN ' x.' ELSE ' x' END AS text, 10.0 + p % 6 + 1.0 / 3 AS avg_size, 11.0 + p % 6 AS max_size, s % 3 = 0 AS bold FROM l),
lev AS (SELECT *, CASE WHEN avg_size >= 14 THEN 1 WHEN avg_size >= 12 AND bold THEN 2 WHEN bold AND NOT ends_with(text, '.') THEN 3 END AS level FROM blk),
-- The first heading is a root; another is one if it is as high as the highest before it.
root AS (SELECT *, level IS NOT NULL AND level <= coalesce(min(level) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS root,
                count(level) OVER (PARTITION BY doc_id ORDER BY b) - 1 + max(CASE WHEN b = 0 AND level IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS ord FROM lev)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct(*[long(c).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("x"))

    def spans(x: Column, b: Column) -> Column:
        size, flags = (x["l_partkey"] % 6 + 10).cast("double"), F.when(x["l_suppkey"] % 3 == 0, 16).otherwise(0)
        one = lambda n, s, text, more=0.0: F.struct(F.floor(b / 3).cast("int").alias("page"), b.alias("block"), F.lit(n).alias("line"), F.lit(s).alias("span"), text.alias("text"), (size + more).alias("size"), flags.alias("flags"))
        last = F.when(x["l_partkey"] % 4 == 0, "x.").otherwise("x")
        return F.array(one(0, 0, F.concat(F.lit("P"), x["l_partkey"])), one(0, 1, F.concat(F.lit("S"), x["l_suppkey"]), 1.0), one(1, 0, last))

    grouped = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("doc_id", F.flatten(F.transform("xs", spans)).cast(pdf.SPANS).alias("spans"))


@query(f"WITH {_LINES} SELECT doc_id, b::BIGINT AS ord, text, round(avg_size, 6)::DOUBLE AS avg_size, max_size::DOUBLE AS max_size, bold FROM blk")
def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _spans(spark, sf_dir).select("doc_id", F.posexplode(pdf.text_blocks(F.col("spans"))).alias("ord", "b"))
    return found.select("doc_id", long("ord").alias("ord"), "b.text", F.round("b.avg_size", 6).alias("avg_size"), "b.max_size", "b.bold")


@query(f"""
WITH {_LINES}
SELECT doc_id, ord::BIGINT AS section_ord, text AS title, level::BIGINT AS level,
       CASE WHEN root THEN -1 ELSE max(CASE WHEN root THEN ord END) OVER (PARTITION BY doc_id ORDER BY b) END::BIGINT AS parent_ord FROM root WHERE level IS NOT NULL
UNION ALL SELECT doc_id, 0, '', 0, -1 FROM root WHERE b = 0 AND level IS NULL""")
def pdf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _spans(spark, sf_dir).select("doc_id", pdf.outline(pdf.text_blocks(F.col("spans"))).alias("d")).select("doc_id", F.inline("d.sections"))
    return found.select("doc_id", long("section_ord").alias("section_ord"), "title", long("level").alias("level"), F.coalesce(long("parent_ord"), F.lit(-1)).alias("parent_ord"))


@query(f"""
WITH {_LINES},
t AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS section FROM root)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS idx, text, coalesce(section, '') AS section FROM t WHERE level IS NULL""")
def pdf_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _spans(spark, sf_dir).select("doc_id", pdf.outline(pdf.text_blocks(F.col("spans"))).alias("d")).select("doc_id", F.inline("d.paragraphs"))
    return found.select("doc_id", long("idx").alias("idx"), "text", "section")


@query(f"WITH {_LINES}, pages AS (SELECT doc_id, b // 3 AS page, string_agg(text, ' ' ORDER BY b) AS text FROM blk GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_id")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", pdf.raw_text(F.col("spans")).alias("text"))


_EXTENSION = "CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.xyz' WHEN 3 THEN '' ELSE '.Text' END"


@query(f"""
SELECT doc_id || '/f' || doc_id || {_EXTENSION} AS path, 'f' || doc_id || {_EXTENSION} AS filename, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 4 THEN 'text' END AS file_type,
       CASE WHEN doc_id % 5 IN (2, 3) THEN 'unsupported' END AS error, CASE WHEN doc_id % 5 IN (0, 4) THEN len({_paragraphs("text")}) WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END::BIGINT AS paragraphs
FROM documents""")
def file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension: a parser each, and an error for those without."""
    text = F.when(F.col("doc_id") % 5 == 1, "# Title\n\nOne paragraph.").otherwise(F.coalesce("text", F.lit("")))
    extension = F.expr(_EXTENSION)
    files = docs(spark, sf_dir).select(F.concat("doc_id", F.lit("/f"), "doc_id", extension).alias("path"), text.cast("binary").alias("content"))
    parsed = R.REGISTRY.parse(files)
    return parsed.select(
        F.col("doc_id").alias("path"), "filename", "file_type", F.when(F.col("error").isNotNull(), F.split("error", " ")[0]).alias("error"),
        long(F.coalesce(F.size("parsed.paragraphs"), F.lit(0))).alias("paragraphs"),
    )


@query(f"WITH para AS (SELECT doc_id, unnest(range(len(ps))) AS idx, unnest(ps) AS text FROM (SELECT doc_id, {_paragraphs('text')} AS ps FROM documents)) SELECT doc_id, idx::BIGINT AS idx, text FROM para")
def atomize_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group size of 0 leaves the paragraphs as they are."""
    parsed = docs(spark, sf_dir).select("doc_id", P.plain(X.text_paragraphs(F.col("text"))).alias("p"))
    return parsed.select("doc_id", F.inline(X.barrier(P.atomize(F.col("p"), F.lit(0), F.lit(6))))).select("doc_id", long("idx").alias("idx"), "text")


@query(f"""
WITH RECURSIVE para AS (SELECT doc_id, unnest(range(len(ps))) AS p0, unnest(ps) AS t FROM (SELECT doc_id, {_paragraphs("text")} AS ps FROM documents)),
sent AS (SELECT doc_id, p0, t, {_sentences("t")} AS ss, trunc(len({_words("t")}) * 1.3::DOUBLE) <= 100 AS fits FROM para),
s AS (SELECT doc_id, p0, i, x, trunc(len({_words("x")}) * 1.3::DOUBLE) AS n FROM (SELECT doc_id, p0, unnest(range(len(ss))) AS i, unnest(ss) AS x FROM sent WHERE NOT fits AND len(ss) > 1)),
r AS (SELECT doc_id, p0, i, x, 0 AS pack, n FROM s WHERE i = 0
      UNION ALL SELECT s.doc_id, s.p0, s.i, s.x, CASE WHEN r.n + s.n > 100 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.n + s.n > 100 THEN s.n ELSE r.n + s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.p0 = r.p0 AND s.i = r.i + 1),
parts AS (SELECT doc_id, p0, 0 AS pack, t AS text FROM sent WHERE fits OR len(ss) <= 1 UNION ALL SELECT doc_id, p0, pack, string_agg(x, ' ' ORDER BY i) FROM r GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p0, pack) - 1 AS idx, text FROM parts""")
def token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed by whole sentences up to 100 tokens."""
    parts = P.split_by_tokens(P.plain(X.text_paragraphs(F.col("text"))), 100)
    return docs(spark, sf_dir).select("doc_id", X.barrier(parts).alias("parts")).select("doc_id", F.inline("parts")).select("doc_id", long("idx").alias("idx"), "text")


def _est(g: str, m: str) -> str:
    return f"coalesce(list_sum(list_transform(counts, lambda c: CASE WHEN c < greatest({m}, {g} + 1) THEN 1 ELSE greatest(1, c // greatest({g}, 1)) END)), 0)"


_NUMBERS = {"e": "doc_id * 7 % 30 + 1", "lo": "doc_id * 11 % 20 + 1", "gs": "doc_id * 5 % 9", "ms": "doc_id * 13 % 12"}


@query(f"""
WITH {_atom_ctes()},
c AS (SELECT doc_id, list(len(ss) ORDER BY p0) AS counts FROM sent GROUP BY doc_id),
b AS (SELECT d.doc_id, coalesce(counts, []) AS counts, {", ".join(f"d.{v} AS {k}" for k, v in _NUMBERS.items())} FROM documents d LEFT JOIN c USING (doc_id)),
p AS (SELECT *, lo + 4 AS hi, len(counts) AS n, CASE WHEN coalesce(list_max(counts), 0) > 0 THEN least(ms, list_max(counts)) ELSE ms END AS start, gs > 0 AS on_ FROM b),
hit AS (SELECT doc_id, max(g * 100 + m) AS best FROM p, (SELECT unnest(range(1, 9)) AS g), (SELECT unnest(range(0, 12)) AS m) WHERE on_ AND g <= gs AND m <= start AND {_est("gs", "ms")} < lo AND {_est("g", "m")} >= lo GROUP BY doc_id),
a AS (SELECT p.* EXCLUDE (gs, ms), coalesce(best // 100, gs) AS gs, coalesce(best % 100, ms) AS ms, best IS NOT NULL AND (best // 100 <> gs OR best % 100 <> ms) AS moved FROM p LEFT JOIN hit USING (doc_id)),
t AS (SELECT a.* EXCLUDE (gs), gs AS g1, on_ AND e > n AND n > 0 AND e >= n * 1.5 AND gs > 2 AND {_est("2", "ms")} <= hi * 3 AS two FROM a),
u AS (SELECT *, CASE WHEN two THEN 2 ELSE g1 END AS g2 FROM t),
v AS (SELECT *, CASE WHEN NOT on_ OR g2 >= 6 THEN g2 ELSE coalesce((SELECT min(g) FROM (SELECT unnest(range(1, 7)) AS g) WHERE g >= g2 AND {_est("g", "ms")} <= hi * 3), 6) END AS g3 FROM u)
SELECT doc_id, g3::BIGINT AS gs, ms::BIGINT AS ms, trim(
  CASE WHEN moved THEN '(Adjusted atomization to avoid under-splitting: ' || g1 || ' sentences/group, min_sentences=' || ms || '.)' ELSE '' END ||
  CASE WHEN two THEN ' (Adjusted atomization to 2 sentences/group to better match the expected chunk granularity.)' ELSE '' END ||
  CASE WHEN g3 <> g2 THEN ' (Adjusted atomization to ' || g3 || ' sentences/group to avoid over-splitting.)' ELSE '' END) AS rationale
FROM v""")
def plan_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans made safe for each document's sentences."""
    n = P.sentence_counts(P.plain(X.text_paragraphs(F.col("text"))))
    rows = docs(spark, sf_dir).select("doc_id", n.alias("counts"), *[F.expr(f"cast({v} AS int)").alias(k) for k, v in _NUMBERS.items()])
    plan = F.struct(
        F.array().cast("array<string>").alias("topics"), F.col("e").alias("expected"), F.col("lo"), (F.col("lo") + 4).alias("hi"), F.col("gs"), F.col("ms"), F.lit("").alias("rationale"), F.lit(0.5).alias("confidence")
    )
    safe = rows.select("doc_id", G.safe_plan(plan, F.col("counts"), F.size("counts")).alias("p"))
    return safe.select("doc_id", long("p.gs").alias("gs"), long("p.ms").alias("ms"), "p.rationale")


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT doc_id, chunk_ord, content, 'chunk_' || lpad((chunk_ord + 1)::VARCHAR, greatest(3, length((chunk_ord + 1)::VARCHAR))::INTEGER, '0') AS chunk_id,
       CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title, 'unknown' AS intent, '' AS parent_section, trunc(len({_words("content")}) * 1.3::DOUBLE)::BIGINT AS token_count
FROM (SELECT *, string_split(content, '. ')[1] AS t FROM chunk)""")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as Markdown with front matter, and read back."""
    written = similarities(spark, sf_dir, True).select("doc_id", sinks.markdown(F.col("chunks")).alias("md")).where("md is not null")
    back = written.select("doc_id", F.posexplode(sinks.read_markdown(F.col("md"))).alias("ord", "c")).select("doc_id", long("ord").alias("chunk_ord"), "c.*")
    return back.select("doc_id", "chunk_ord", "content", *[f"metadata.{k}" for k in ("chunk_id", "title", "intent", "parent_section")], long("metadata.token_count").alias("token_count"))


_WHOLE = "atom AS (SELECT doc_id, unnest(range(len(ps))) AS idx, unnest(ps) AS text, unnest(range(len(ps))) AS src FROM (SELECT doc_id, " + _paragraphs("text") + " AS ps FROM documents))"
_COUNTS = {
    "paragraph_count": "(SELECT count(*) FROM atom WHERE atom.doc_id = d.doc_id)", "paragraphs_after_atomize": "(SELECT count(*) FROM atom WHERE atom.doc_id = d.doc_id)",
    **dict.fromkeys(["boundary_proposals_count", "boundaries_validated", "boundaries_kept"], f"(SELECT count(*) FROM sim WHERE sim.doc_id = d.doc_id AND similarity < {THRESHOLD})"), "boundaries_merged": "0",
    **dict.fromkeys(["chunks_formed", "chunks_enriched"], "(SELECT count(*) FROM chunk WHERE chunk.doc_id = d.doc_id)"),
}


def _with_model(spark: SparkSession, sf_dir: str):
    """A run with a model that answers every question the same; its plan asks for no atoms."""
    return Pipeline(Context(Config(similarity_threshold=THRESHOLD), FixedModel())).run(R.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query(f"WITH {_WHOLE}, {_SIM_CTES}, {_CHUNK_CTES} " + " UNION ALL ".join(f"SELECT d.doc_id, '{k}' AS key, {v}::VARCHAR AS value FROM documents d" for k, v in _COUNTS.items()))
def model_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all stages with a language model whose replies are fixed."""
    return _with_model(spark, sf_dir).metrics.where(F.col("key").isin(*_COUNTS))


@query(f"""
WITH {_WHOLE}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT doc_id, 'plan' AS kind, count(*)::BIGINT AS calls, true AS success FROM (SELECT DISTINCT doc_id FROM atom) GROUP BY doc_id
UNION ALL SELECT doc_id, 'check', count(*), true FROM sim WHERE similarity < {THRESHOLD} GROUP BY doc_id
UNION ALL SELECT doc_id, 'enrich', count(*), true FROM chunk GROUP BY doc_id""")
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of calls: one to plan, one for each proposal, one for each chunk."""
    calls = _with_model(spark, sf_dir).calls
    return calls.groupBy("doc_id", "kind").agg(F.count("*").alias("calls"), F.min("success").alias("success"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}
SELECT s.doc_id, s.position::BIGINT AS position, md5('Before the break:' || chr(10) || '<<<' || chr(10) || CASE WHEN length(a.text) > 500 THEN '...' || right(a.text, 500) ELSE a.text END || chr(10) || '>>>' || chr(10) || 'After the break:' || chr(10) || '<<<' || chr(10) ||
       CASE WHEN length(b.text) > 500 THEN left(b.text, 500) || '...' ELSE b.text END || chr(10) || '>>>' || chr(10) || 'Reply with the keys verdict ("KEEP", "MERGE" or "ADJUST"), reason, confidence (0 to 1).') AS prompt
FROM sim s JOIN atom a ON a.doc_id = s.doc_id AND a.idx = s.position - 1 JOIN atom b ON b.doc_id = s.doc_id AND b.idx = s.position WHERE s.similarity < {THRESHOLD}""")
def check_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is asked about each proposal, as digests."""
    made = F.transform(F.arrays_zip(F.col("proposals"), B.previews(F.col("proposals")).alias("shown")), lambda x: F.struct(x["proposals"]["position"].alias("position"), prompts.check_prompt(x["shown"]["before"], x["shown"]["after"]).alias("p")))
    found = similarities(spark, sf_dir).select("doc_id", F.inline(made))
    return found.select("doc_id", long("position").alias("position"), F.md5(F.col("p").cast("binary")).alias("prompt"))


@query(f"""
WITH {_atom_ctes()}, {_SIM_CTES}, {_CHUNK_CTES}
SELECT doc_id, chunk_ord, length('Section: Document Root' || chr(10) || 'Passage:' || chr(10) || '<<<' || chr(10) || content || chr(10) || '>>>' || chr(10)) + {len(prompts.ENRICH_KEYS)} AS chars FROM chunk""")
def enrich_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the model's prompt about each chunk is."""
    made = similarities(spark, sf_dir).select("doc_id", F.inline("chunks"))
    return made.select("doc_id", long("chunk_ord").alias("chunk_ord"), long(F.length(prompts.enrich_prompt(F.col("content"), F.col("parent_section")))).alias("chars"))


@query("""
WITH p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS u FROM embeddings)
SELECT label, i::BIGINT AS position, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 9) + 0.0 AS similarity FROM p WHERE u IS NOT NULL""")
def adjacent_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines along an array of vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    found = rows.select("label", F.posexplode(V.adjacent_cosines(F.transform("v", lambda x: x["embedding"]))).alias("i", "similarity"))
    return found.select("label", (long("i") + 1).alias("position"), (F.round("similarity", 9) + 0.0).alias("similarity"))


_PLACES = 64
_HASHED = _SIM_CTES.replace("SELECT doc_id, idx, w, count(*) AS n FROM (SELECT doc_id, idx, unnest(", f"SELECT doc_id, idx, ('0x' || left(md5(w), 8))::UBIGINT % {_PLACES} AS w, count(*) AS n FROM (SELECT doc_id, idx, unnest(")
_HASHED = _HASHED.replace(" AS w FROM atom) GROUP BY ALL)", " AS w FROM atom) GROUP BY 1, 2, 3)", 1)


@query(f"WITH {_atom_ctes()}, {_HASHED} SELECT doc_id, position::BIGINT AS position, round(similarity, 9) AS similarity FROM sim WHERE similarity < 0.47")
def embedded_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals by an embedder: hashed word counts in few places."""
    pipeline = Pipeline(Context(Config(similarity_threshold=0.47), embedder=HashEmbedder(_PLACES)))
    pipeline.remove("enrich")
    found = pipeline.run(R.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))).documents.select("doc_id", F.inline("proposals"))
    return found.select("doc_id", long("position").alias("position"), F.round("similarity", 9).alias("similarity"))


@query(f"WITH {_atom_ctes()}, {_SIM_CTES} SELECT doc_id, position::BIGINT AS position, similarity, 'KEEP' AS verdict FROM sim WHERE similarity < {THRESHOLD}")
def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of decisions that a run can be stored with."""
    rows = sinks.stage_tables(similarities(spark, sf_dir))["decisions"]
    return rows.select("doc_id", long("position").alias("position"), "similarity", "verdict")


@query(f"WITH {_atom_ctes()} SELECT doc_id, idx::BIGINT AS idx, text, src::BIGINT AS source_idx, 'paragraph' AS element_type FROM atom")
def paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of paragraphs that a run can be stored with."""
    rows = sinks.stage_tables(similarities(spark, sf_dir))["paragraphs"]
    return rows.select("doc_id", long("idx").alias("idx"), "text", long("source_idx").alias("source_idx"), "element_type")
