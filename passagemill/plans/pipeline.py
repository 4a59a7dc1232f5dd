"""The chunking pipeline as a whole: stages in order, a facade, a builder and a result."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import ConfigError
from ..functions import prompts
from ..providers import BpeCounter, ChatModel, Embedder, HttpChatModel, SentenceTransformerEmbedder, TokenCounter
from ..session import ship
from ..sinks import write_markdown
from ..sources import registry as sources
from .stages import Context, Stage, default_stages, metrics

Progress = Callable[[str, float], None]


@dataclass
class Result:
    """What a run leaves: a row per document, and views of it."""

    documents: DataFrame
    config: Config
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    #: Seconds of the whole run and of each stage: of planning alone, unless ``measured``, when the work is in it.
    total_time: float = 0.0
    stage_times: dict[str, float] = field(default_factory=dict)
    measured: bool = False
    output_path: str | None = None

    @property
    def success(self) -> bool:
        """Whether no stage failed; of a run that isn't measured, no stage's planning."""
        return not self.errors

    @property
    def chunks(self) -> DataFrame:
        """A row per chunk, in order within its document."""
        return self.documents.select("doc_id", "filename", F.inline("chunks"))

    @property
    def events(self) -> DataFrame:
        return self.documents.select("doc_id", F.inline("events"))

    @property
    def metrics(self) -> DataFrame:
        return metrics(self.documents, self.config)

    @property
    def calls(self) -> DataFrame:
        """A row per call of a language model, with its prompts."""
        systems = {"plan": prompts.PLAN_SYSTEM, "check": prompts.CHECK_SYSTEM, "enrich": prompts.ENRICH_SYSTEM}
        parts = [
            self.documents.select("doc_id", F.lit(kind).alias("kind"), F.inline(F.arrays_zip(F.col(f"{kind}_replies_of").alias("prompt"), F.col(f"{kind}_replies").alias("r"))))
            .select("doc_id", "kind", "prompt", F.lit(system).alias("system_prompt"), "r.*")
            for kind, system in systems.items()
            if f"{kind}_replies" in self.documents.columns
        ]
        none = "doc_id string, kind string, prompt string, system_prompt string, content string, tokens_used int, success boolean, error string"
        return reduce(DataFrame.unionByName, parts) if parts else self.documents.sparkSession.createDataFrame([], none)

    def chunk_count(self) -> int:
        return self.documents.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0))).first()[0]

    def total_tokens(self) -> int:
        total = F.aggregate("chunks", F.lit(0), lambda a, c: a + F.coalesce(c["metadata"]["token_count"], F.lit(0)))
        return self.documents.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]

    def has_warnings(self) -> bool:
        return bool(self.warnings) or not self.events.where("level = 'warning'").isEmpty()

    def has_errors(self) -> bool:
        return bool(self.errors) or not self.events.where("level = 'error'").isEmpty()

    def to_dict(self) -> dict:
        return {"success": self.success, "output_path": self.output_path, "chunk_count": self.chunk_count(), "total_tokens": self.total_tokens(), "warnings": self.warnings, "errors": self.errors}


class Pipeline:
    """Stages that run in order; a stage that raises stops the run unless the settings say to go on."""

    def __init__(self, context: Context, stages: list[Stage] | None = None):
        self.context = context
        self.stages = default_stages() if stages is None else list(stages)

    @property
    def stage_names(self) -> list[str]:
        return [s.name for s in self.stages]

    def add(self, stage: Stage) -> Pipeline:
        self.stages.append(stage)
        return self

    def insert(self, at: int, stage: Stage) -> Pipeline:
        self.stages.insert(at, stage)
        return self

    def remove(self, name: str) -> bool:
        left = [s for s in self.stages if s.name != name]
        found = len(left) < len(self.stages)
        self.stages = left
        return found

    def run(self, documents: DataFrame, progress: Progress | None = None, measure: bool = False) -> Result:
        """The documents after all stages. Stages are plans, which run when their result is read.

        With ``measure`` each stage runs at once and its rows are held, so that times, progress and
        errors are those of the work.
        """
        began = time.time()
        result = Result(documents, self.context.config, measured=measure)
        for i, stage in enumerate(self.stages):
            start = time.time()
            try:
                if not stage.should_skip(self.context):
                    made = stage.process(result.documents, self.context)
                    if measure:
                        made = made.persist(StorageLevel.MEMORY_AND_DISK)
                        made.write.format("noop").mode("overwrite").save()
                    result.documents = made
                    result.stage_times[stage.name] = time.time() - start
            except Exception as e:
                result.errors.append(f"{stage.name}: {e}")
                if not self.context.config.continue_on_error:
                    break
            if progress:
                progress(stage.name, (i + 1) / len(self.stages))
        result.total_time = time.time() - began
        return result


class Chunker:
    """Chunks documents of files, tables or texts.

    Without a model boundaries are kept as proposed and metadata is made from the text. With one,
    replies are held on the executors, so that each prompt is sent once as long as these live;
    ``keep``, a function that writes a table and reads it back, makes that certain.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, model: ChatModel | None = None, embedder: Embedder | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, counter: TokenCounter | None = None):
        self.spark, self.config = ship(spark), config or Config()
        self.model, self.embedder, self.counter = model, embedder, counter
        self.keep = keep or ((lambda df, name: df) if model is None else (lambda df, name: df.persist(StorageLevel.MEMORY_AND_DISK)))

    @classmethod
    def with_api(cls, spark: SparkSession, api_key: str | None, model: str = "gpt-4o", config: Config | None = None, base_url: str | None = None) -> Chunker:
        if not api_key:
            raise ConfigError("an API key or a model is needed", "api_key")
        c = config or Config()
        chat = HttpChatModel(model, api_key, temperature=c.llm_temperature, max_tokens=c.llm_max_tokens)
        if base_url:
            chat.base_url = base_url
        return cls(spark, c, chat)

    @staticmethod
    def builder(spark: SparkSession) -> Builder:
        return Builder(spark)

    def _context(self, dry_run: bool) -> Context:
        return Context(self.config, self.model, self.embedder, self.counter, dry_run, self.keep)

    def run(self, documents: DataFrame, dry_run: bool = False, progress: Progress | None = None, measure: bool = False) -> Result:
        return Pipeline(self._context(dry_run)).run(documents, progress, measure)

    def chunk_files(self, path: str, output_dir: str | None = None, dry_run: bool = False, progress: Progress | None = None) -> Result:
        """Chunk all files under a path; with ``output_dir`` write a Markdown file for each."""
        result = self.run(sources.read_files(self.spark, path), dry_run, progress)
        if output_dir is not None:
            result.output_path = write_markdown(result.documents, output_dir)
        return result

    def chunk_table(self, rows: DataFrame, doc_id: str = "doc_id", text: str = "text", dry_run: bool = False) -> Result:
        return self.run(sources.from_table(rows, doc_id, text), dry_run)

    def chunk_text(self, text: str) -> list:
        """The chunks of one text, as rows."""
        return self.run(sources.from_texts(self.spark, [text])).chunks.orderBy("chunk_ord").collect()


class Builder:
    """Collects what a Chunker needs."""

    def __init__(self, spark: SparkSession):
        self._spark, self._parts = spark, {}

    def config(self, config: Config) -> Builder:
        self._parts["config"] = config
        return self

    def model(self, model: ChatModel) -> Builder:
        self._parts["model"] = model
        return self

    def embedder(self, embedder: Embedder) -> Builder:
        self._parts["embedder"] = embedder
        return self

    def neural(self) -> Builder:
        """The sentence-transformers model that the settings name."""
        c = self._parts.get("config") or Config()
        return self.embedder(SentenceTransformerEmbedder(c.embedding_model, c.embedding_device))

    def tokens(self, folder: str) -> Builder:
        """Tokens as the model that the settings name counts them, by a vocabulary file in a folder that all machines see."""
        return self.counter(BpeCounter.for_model((self._parts.get("config") or Config()).token_model, folder))

    def counter(self, counter: TokenCounter) -> Builder:
        self._parts["counter"] = counter
        return self

    def keep(self, keep: Callable[[DataFrame, str], DataFrame]) -> Builder:
        self._parts["keep"] = keep
        return self

    def build(self) -> Chunker:
        return Chunker(self._spark, **self._parts)
