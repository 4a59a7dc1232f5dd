"""The stages of a chunking run. Each takes and returns a DataFrame with a row per document.

Columns as they come: doc_id, filename, file_type, parsed, error; then paragraphs, sections,
short; plan; similarities, proposals; decisions; chunks; and throughout the arrays ``events``
(level, stage, message) and what the metrics are computed from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import prompts, replies
from ..functions.text import approx_tokens, barrier
from ..functions.vectors import adjacent_cosines, float_cosine, statistics
from ..operators import boundaries, chunks, paragraphs, planner
from ..providers import ChatModel, Embedder, Retry, TokenCounter, ask, count_tokens, embed
from ..schema import PARAGRAPHS, SECTIONS

EVENTS = "array<struct<level:string,stage:string,message:string>>"


@dataclass
class Context:
    """What all stages share."""

    config: Config = field(default_factory=Config)
    model: ChatModel | None = None
    #: None compares word counts, which needs no vectors.
    embedder: Embedder | None = None
    #: None counts tokens as words times 1.3.
    counter: TokenCounter | None = None
    dry_run: bool = False
    #: Writes a table and reads it back, so that no model is asked twice; identity by default.
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df

    @property
    def retry(self) -> Retry:
        return Retry(self.config.retry_attempts, self.config.retry_delay)


class Stage(Protocol):
    name: str

    def should_skip(self, context: Context) -> bool: ...

    def process(self, df: DataFrame, context: Context) -> DataFrame: ...


def _event(level: str, stage: str, message: Column) -> Column:
    return F.array(F.struct(F.lit(level).alias("level"), F.lit(stage).alias("stage"), message.alias("message"))).cast(EVENTS)


def _add(when: Column, level: str, stage: str, message) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(when, F.concat("events", _event(level, stage, text))).otherwise(F.col("events"))


def _call(df: DataFrame, name: str, argument: Column, function: Callable[[Column], Column]) -> DataFrame:
    """``df`` with a column that a Python function makes of ``argument``, which is ``<name>_of``."""
    return df.withColumn(f"{name}_of", barrier(argument)).withColumn(name, function(F.col(f"{name}_of")))


class _Base:
    name = ""

    def should_skip(self, context: Context) -> bool:
        return False


class Parse(_Base):
    """Documents to paragraphs and sections; one that failed keeps a row, an error and no paragraphs."""

    name = "parse"

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        failed = F.col("error").isNotNull()
        return df.select(
            "doc_id", "filename", "file_type",
            F.coalesce("parsed.paragraphs", F.array().cast(PARAGRAPHS)).alias("paragraphs"),
            F.coalesce("parsed.sections", F.array().cast(SECTIONS)).alias("sections"),
            F.when(failed, _event("error", self.name, F.col("error"))).otherwise(F.array().cast(EVENTS)).alias("events"),
            F.size(F.filter(F.coalesce("parsed.sections", F.array().cast(SECTIONS)), lambda s: s["parent_ord"].isNull())).alias("section_count"),
        )


class Segment(_Base):
    """Marks short documents, and counts."""

    name = "segment"

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        n = F.size("paragraphs")
        few = n < context.config.short_document_threshold
        df = df.withColumns({"short": few, "paragraph_count": n, "atomic_element_count": paragraphs.atomic_count(F.col("paragraphs"))})
        df = df.withColumn("events", _add(few, "warning", self.name, F.concat(F.lit("short document: "), n.cast("string"), F.lit(" paragraphs"))))
        return df.withColumn("events", _add(n == 0, "warning", self.name, "document has no paragraphs"))


class Granularity(_Base):
    """Asks the model how finely to atomize each document; whatever fails leaves the settings."""

    name = "granularity"

    def should_skip(self, context: Context) -> bool:
        return context.dry_run or not context.config.granularity_planning_enabled or context.model is None

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        c = context.config
        lines = planner.paragraph_lines(F.col("paragraphs"), c.granularity_max_paragraphs, c.granularity_max_chars_per_paragraph)
        titles = planner.title_list(F.transform("sections", lambda s: s["title"]))
        prompt = prompts.plan_prompt(F.coalesce("file_type", F.lit("")), titles, lines, F.size("paragraphs"), F.col("section_count"), c)
        asked = F.when(F.size("paragraphs") > 0, F.array(prompt)).otherwise(F.array().cast("array<string>"))
        # One call, without retries.
        df = context.keep(_call(df, "plan_replies", asked, lambda a: ask(context.model, a, prompts.PLAN_SYSTEM)), "plans")
        reply = F.get("plan_replies", F.lit(0))
        body = F.when(reply["success"], replies.json_object(reply["content"]))
        plan = planner.safe_plan(planner.normalise_plan(body, F.size("paragraphs"), c.atomize_min_sentences), paragraphs.sentence_counts(F.col("paragraphs")), F.size("paragraphs"))
        df = df.withColumn("plan", F.when(body.isNotNull(), plan))
        return df.withColumn("events", _add((F.size("paragraphs") > 0) & F.col("plan").isNull(), "warning", self.name, "granularity planning failed"))


class Atomize(_Base):
    """Long paragraphs to sentence groups, by the plan's numbers where a document has one."""

    name = "atomize"

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        c = context.config
        gs, ms = F.lit(c.atomize_sentences_per_paragraph), F.lit(c.atomize_min_sentences)
        if "plan" in df.columns:
            gs, ms = F.coalesce("plan.gs", gs), F.coalesce("plan.ms", ms)
        # Columns that nobody reads, such as what only metrics need, cost nothing.
        df = df.withColumns({"gs": gs, "ms": ms, "paragraphs_before_atomize": F.size("paragraphs"), "sentence_counts": paragraphs.sentence_counts(F.col("paragraphs"))})
        long = F.filter("sentence_counts", lambda n: (F.col("gs") > 0) & (n >= F.greatest("ms", F.col("gs") + 1)))
        df = df.withColumns({
            "paragraphs_atomized": F.size(long),
            "atoms_total": F.aggregate(long, F.lit(0), lambda a, n: a + F.greatest(F.lit(1), F.floor(n / F.col("gs")).cast("int"))),
            "paragraphs": barrier(paragraphs.atomize(F.col("paragraphs"), F.col("gs"), F.col("ms"))),
        })
        enough = F.col("short") & (F.size("paragraphs") >= c.short_document_threshold)
        df = df.withColumns({"short": F.col("short") & ~enough, "events": _add(enough, "warning", self.name, "atomized document is no longer short")})
        return df.withColumnsRenamed({"gs": "atomize_sentences_per_paragraph", "ms": "atomize_min_sentences"}).drop("sentence_counts")


class DetectBoundaries(_Base):
    """Proposes a boundary wherever neighbours are not alike; none in a short document."""

    name = "boundary_detect"

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        none = F.array().cast("array<string>")
        texts = F.when(F.col("short"), none).otherwise(boundaries.splittable_texts(F.col("paragraphs")))
        if context.embedder is None:
            df = _call(df, "similarities", texts, boundaries.adjacent_lexical).drop("similarities_of")
        else:
            df = context.keep(_call(df, "vectors", texts, lambda a: embed(context.embedder, a)), "vectors")
            df = df.withColumn("similarities", adjacent_cosines(F.col("vectors"), float_cosine)).drop("vectors", "vectors_of")
        return df.withColumn("proposals", barrier(boundaries.propose(F.col("paragraphs"), F.col("similarities"), context.config.similarity_threshold)))


class ValidateBoundaries(_Base):
    """Asks the model about each proposal; without a model each is kept."""

    name = "boundary_validate"

    def should_skip(self, context: Context) -> bool:
        return context.dry_run

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        if context.model is None:
            return df.withColumn("decisions", boundaries.keep_all(F.col("proposals")))
        asked = F.transform(boundaries.previews(F.col("proposals")), lambda p: prompts.check_prompt(p["before"], p["after"]))
        df = context.keep(_call(df, "check_replies", asked, lambda a: ask(context.model, a, prompts.CHECK_SYSTEM, context.retry)), "checks")
        answers = F.transform("check_replies", lambda r: replies.boundary_answer(F.when(r["success"], r["content"])))
        df = df.withColumn("answers", answers)
        lost = F.exists("answers", lambda a: ~a["ok"])
        return df.withColumns({"decisions": boundaries.decide(F.col("proposals"), F.col("answers")), "events": _add(lost, "warning", self.name, "boundary validation failed")}).drop("answers")


class FormChunks(_Base):
    """Cuts the paragraphs at the decisions. Without decisions (a dry run) a document is one chunk."""

    name = "chunk_form"

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        none = F.array().cast("array<int>")
        positions = boundaries.split_positions(F.col("decisions")) if "decisions" in df.columns else none
        return df.withColumn("chunks", barrier(chunks.form_chunks(F.col("paragraphs"), F.when(F.col("short"), none).otherwise(positions))))


class Enrich(_Base):
    """Metadata for each chunk: the model's, or made from the text where it fails."""

    name = "enrich"

    def should_skip(self, context: Context) -> bool:
        return context.dry_run

    def process(self, df: DataFrame, context: Context) -> DataFrame:
        df = self._described(df, context)
        if context.counter is None:
            return df
        df = _call(df, "token_counts", F.transform("chunks", lambda c: c["content"]), lambda a: count_tokens(context.counter, a))
        counted = F.zip_with("chunks", "token_counts", lambda c, n: c.withField("metadata", F.when(c["metadata"].isNotNull(), c["metadata"].withField("token_count", n))))
        return df.withColumn("chunks", barrier(counted)).drop("token_counts", "token_counts_of")

    def _described(self, df: DataFrame, context: Context) -> DataFrame:
        if context.model is None:
            return df.withColumn("chunks", barrier(chunks.enrich(F.col("chunks"))))
        asked = F.transform("chunks", lambda c: prompts.enrich_prompt(c["content"], c["parent_section"]))
        df = context.keep(_call(df, "enrich_replies", asked, lambda a: ask(context.model, a, prompts.ENRICH_SYSTEM, context.retry)), "metadata")
        df = df.withColumn("answers", F.transform("enrich_replies", lambda r: replies.chunk_answer(F.when(r["success"], r["content"]))))
        fallback = context.config.fallback_enabled
        lost = F.exists("answers", lambda a: ~a["ok"])
        made = barrier(chunks.enrich(F.col("chunks"), F.col("answers"), fallback, approx_tokens))
        return df.withColumns({"chunks": made, "events": _add(lost, "warning" if fallback else "error", self.name, "enrichment failed")}).drop("answers")


def default_stages() -> list[Stage]:
    return [Parse(), Segment(), Granularity(), Atomize(), DetectBoundaries(), ValidateBoundaries(), FormChunks(), Enrich()]


def metrics(df: DataFrame, config: Config) -> DataFrame:
    """Metrics in long form, (doc_id, key, value as text), of what the stages left."""
    have = set(df.columns)
    count = lambda name, of: F.struct(F.lit(name).alias("key"), of.cast("string").alias("value"))
    kept = lambda v: F.size(F.filter("decisions", lambda d: d["verdict"] == v))
    made = {
        "file_type": ("file_type", lambda: F.col("file_type")), "section_count": ("section_count", lambda: F.col("section_count")),
        "paragraph_count": ("paragraph_count", lambda: F.col("paragraph_count")), "atomic_element_count": ("atomic_element_count", lambda: F.col("atomic_element_count")),
        "granularity_plan": ("plan", lambda: F.to_json("plan")), "granularity_planning_failed": ("plan", lambda: F.col("plan").isNull()),
        "paragraphs_after_atomize": ("atoms_total", lambda: F.size("paragraphs")),
        **{k: (k, lambda k=k: F.col(k)) for k in ("paragraphs_before_atomize", "paragraphs_atomized", "atoms_total", "atomize_sentences_per_paragraph", "atomize_min_sentences")},
        "similarity_stats": ("similarities", lambda: F.to_json(statistics(F.col("similarities")))), "boundary_proposals_count": ("proposals", lambda: F.size("proposals")),
        "similarity_threshold": ("proposals", lambda: F.lit(config.similarity_threshold)), "boundaries_validated": ("decisions", lambda: F.size("decisions")),
        "boundaries_kept": ("decisions", lambda: kept("KEEP")), "boundaries_merged": ("decisions", lambda: kept("MERGE")), "chunks_formed": ("chunks", lambda: F.size("chunks")),
        "chunks_enriched": ("chunks", lambda: F.size(F.filter("chunks", lambda c: c["metadata"].isNotNull()))),
    }
    rows = [count(name, of()) for name, (needs, of) in made.items() if needs in have]
    return df.select("doc_id", F.inline(F.array(*rows)))
