"""Parsers by file extension, and the readers that use them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedTypeError
from ..schema import PARSED
from . import markdown, pdf, text

#: A parser takes the column of a file's bytes and returns one of type PARSED, null where it fails.
Parser = Callable[[Column], Column]


def _markdown(content: Column) -> Column:
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, markdown.parse(F.when(valid, content.cast("string"))))


def _text(content: Column) -> Column:
    return text.parse(text.decode(content))


# Which extensions belong to which format.
DEFAULTS: dict[str, tuple[str, Parser]] = {
    **dict.fromkeys([".txt", ".text"], ("text", _text)),
    **dict.fromkeys([".md", ".markdown", ".mdown", ".mkd"], ("markdown", _markdown)),
    ".pdf": ("pdf", pdf.parse),
}


class Registry:
    """Extension to (format name, parser)."""

    def __init__(self) -> None:
        self._known = dict(DEFAULTS)

    def register(self, extension: str, name: str, parser: Parser) -> None:
        self._known[self._key(extension)] = (name, parser)

    def unregister(self, extension: str) -> None:
        self._known.pop(self._key(extension), None)

    def reset(self) -> None:
        self._known = dict(DEFAULTS)

    def extensions(self) -> list[str]:
        return sorted(self._known)

    def is_supported(self, path: str) -> bool:
        return self._suffix(path) in self._known

    def parser(self, extension: str) -> tuple[str, Parser]:
        key = self._key(extension)
        if key not in self._known:
            raise UnsupportedTypeError(key, self.extensions())
        return self._known[key]

    @staticmethod
    def _key(extension: str) -> str:
        return extension.lower() if extension.startswith(".") else "." + extension.lower()

    @staticmethod
    def _suffix(path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        return "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""

    def parse(self, files: DataFrame) -> DataFrame:
        """Documents of ``files(path, content)``: doc_id, filename, file_type, parsed, error.

        One filtered branch per format, so each runs its own parser only; a file that fails, or
        has no parser, is a row with an error and null ``parsed``.
        """
        name = F.regexp_extract("path", r"[^/]*$", 0)
        suffix = F.lower(F.regexp_extract(name, r"(?<=.)\.[^.]+$", 0))
        named = files.select(F.col("path").alias("doc_id"), name.alias("filename"), suffix.alias("suffix"), "content")
        formats: dict[str, list[str]] = {}
        for extension, (kind, _) in self._known.items():
            formats.setdefault(kind, []).append(extension)
        parts = []
        for kind, extensions in sorted(formats.items()):
            own = named.where(F.col("suffix").isin(extensions))
            parsed = own.select("doc_id", "filename", F.lit(kind).alias("file_type"), self._known[extensions[0]][1](F.col("content")).alias("parsed"))
            parts.append(parsed.withColumn("error", F.when(F.col("parsed").isNull(), F.lit(f"failed to parse {kind} file"))))
        rest = named.where(~F.col("suffix").isin(self.extensions()))
        message = F.concat(F.lit("unsupported file type '"), F.col("suffix"), F.lit("'; supported: " + ", ".join(self.extensions())))
        parts.append(rest.select("doc_id", "filename", F.lit(None).cast("string").alias("file_type"), F.lit(None).cast(parts[0].schema["parsed"].dataType).alias("parsed"), message.alias("error")))
        return reduce(DataFrame.unionByName, parts)


REGISTRY = Registry()


def read_files(spark: SparkSession, path: str, registry: Registry = REGISTRY) -> DataFrame:
    """Documents of all files under a path or glob; a path that isn't there is a row with an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return registry.parse(reader.load(path).select("path", "content"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    lost = spark.createDataFrame([(path, path.rstrip("/").rsplit("/", 1)[-1])], "doc_id string, filename string")
    return lost.select("doc_id", "filename", F.lit(None).cast("string").alias("file_type"), F.lit(None).cast(PARSED).alias("parsed"), F.concat(F.lit("file not found: "), "doc_id").alias("error"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out over all cores if they are too few bytes to fill a split for each.

    A small file is often one row group, which one task would read and then work on alone. A table
    that fills its splits is read as it lies: dealing it out would cost a shuffle and gain nothing.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if size < cores * split else rows


def from_table(rows: DataFrame, doc_id: str = "doc_id", raw: str = "text", parse: Parser = text.parse, file_type: str = "text") -> DataFrame:
    """Documents of a table with an id and a text column."""
    key = F.col(doc_id)
    return spread(rows.select(doc_id, raw)).select(key.alias("doc_id"), key.cast("string").alias("filename"), F.lit(file_type).alias("file_type"), parse(F.col(raw)).alias("parsed"), F.lit(None).cast("string").alias("error"))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Documents of texts in memory."""
    return from_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def from_conversations(turns: DataFrame) -> DataFrame:
    """A document per conversation, a paragraph per turn that is not blank."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: text.collapse_turn(t["text"]))
    grouped = turns.groupBy("conv_id").agg(F.array_remove(said, "").alias("texts"))
    return grouped.select(F.col("conv_id").alias("doc_id"), F.col("conv_id").cast("string").alias("filename"), F.lit("text").alias("file_type"), text.outline(F.col("texts")).alias("parsed"), F.lit(None).cast("string").alias("error"))
