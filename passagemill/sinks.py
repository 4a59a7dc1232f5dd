"""Sinks: Markdown with front matter, JSON, Parquet, and the record of model calls."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import METADATA

#: Default start of output file names; the document's name without its suffix follows.
FILE_PREFIX = "chunks_"
#: The order of the keys in a chunk's front matter.
KEYS = ["chunk_id", "title", "summary", "intent", "questions", "keywords", "parent_section", "token_count"]
#: Characters of rendered text, about, that a Python worker makes or reads at once.
PIECE_SIZE = 1 << 18

#: A text that YAML writes as it is, on one line, and reads back as the same text; an empty one is ''.
_PLAIN = r"(?!(?i:yes|no|true|false|on|off|null)(?:\n|\Z))[A-Za-z\u00c0-\u024f](?:[A-Za-z0-9 .,?!'()/;_\u00c0-\u024f-]*[A-Za-z0-9.,?!'()/;_\u00c0-\u024f-])?"
_ITEMS = rf"(?: \[\]\n|\n(?:- (?:''|{_PLAIN})\n)+)"
PLAIN = re.compile(_PLAIN)
PLAIN_BODY = re.compile("".join(rf"{k}:({_ITEMS})" if k in ("questions", "keywords") else rf"{k}: (0|[1-9][0-9]{{0,17}})\n" if k == "token_count" else rf"{k}: (''|{_PLAIN})\n" for k in KEYS))


def _plain_body(metadata: dict) -> str | None:
    """What YAML makes of metadata of plain texts alone, many times faster; null for any other."""
    out = []
    for k in KEYS:
        v = metadata[k]
        if k == "token_count":
            if type(v) is not int or not 0 <= v < 10**18:
                return None
            out.append(f"{k}: {v}\n")
            continue
        listed = isinstance(v, (list, tuple))
        if listed != (k in ("questions", "keywords")) or not all(type(x) is str and (not x or PLAIN.fullmatch(x)) for x in (v if listed else [v])):
            return None
        if listed:
            out.append(f"{k}:\n" + "".join(f"- {x}\n" if x else "- ''\n" for x in v) if v else f"{k}: []\n")
        else:
            out.append(f"{k}: {v}\n" if v else f"{k}: ''\n")
    return "".join(out)


def _read_plain(body: str) -> dict | None:
    """The metadata of such a text; null for any other."""
    found = PLAIN_BODY.fullmatch(body)
    if not found:
        return None
    text = lambda x: "" if x == "''" else x
    items = lambda x: [] if x == " []\n" else [text(line[2:]) for line in x[1:-1].split("\n")]
    read = {"questions": items, "keywords": items, "token_count": int}
    return {k: read.get(k, text)(v) for k, v in zip(KEYS, found.groups())}


def _pieces(rows: pd.Series) -> Iterator[pd.Series]:
    """The rows in order, a few at a time: so much text that what is made of it stays small."""
    begin = total = 0
    for i, t in enumerate(rows):
        total += len(t or "")
        if total >= PIECE_SIZE:
            yield rows.iloc[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(rows):
        yield rows.iloc[begin:]


def front_matter(metadata: dict | None) -> str:
    """A chunk's metadata as YAML between rules; ``{}`` without any."""
    if metadata and (plain := _plain_body(metadata)) is not None:
        return "---\n" + plain + "---\n"
    import yaml

    body = {k: metadata[k] if not isinstance(metadata[k], (list, tuple)) else list(metadata[k]) for k in KEYS} if metadata else {}
    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
    return "---\n" + yaml.dump(body, Dumper=dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10**9) + "---\n"


def render(chunks) -> str:
    """All chunks of a document, each its front matter, a blank line and its content."""
    parts = []
    for c in sorted(chunks, key=lambda c: c["chunk_ord"]):
        metadata = c["metadata"]
        if metadata is not None and not isinstance(metadata, dict):
            metadata = metadata.asDict(recursive=True)
        parts.append(front_matter(metadata) + "\n" + c["content"] + "\n")
    return "\n".join(parts)


def markdown(chunks: Column) -> Column:
    """The rendered Markdown of a column of chunk arrays; null where there are none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for rows in _pieces(batch):
                yield rows.map(lambda t: render(json.loads(t)) if t else None)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.when(F.size(chunks) > 0, F.to_json(chunks, {"ignoreNullFields": "false"}))
    return F.pandas_udf(run, "string").asNondeterministic()(text)


PIECE = re.compile(r"\n\n---\n(?=chunk_id: |\{\}\n)")


def parse_rendered(text: str) -> list[dict]:
    """The chunks of what :func:`render` wrote: their metadata, null for none, and their content."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    out = []
    for part in PIECE.split("\n\n" + text[:-1])[1:]:
        body, content = part.split("---\n\n", 1)
        out.append({"metadata": _read_plain(body) or yaml.load(body, Loader=loader) or None, "content": content})
    return out


def read_markdown(text: Column) -> Column:
    """Chunks (metadata, content) of a column of rendered documents; none for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for rows in _pieces(batch):
                yield rows.map(lambda t: parse_rendered(t) if t else [])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, f"array<struct<metadata:{METADATA},content:string>>").asNondeterministic()(text)


def stage_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """What the stages made, a table each with a row per element: paragraphs, proposals, decisions, chunks."""
    return {name: documents.select("doc_id", F.inline(name)) for name in ("paragraphs", "proposals", "decisions", "chunks") if name in documents.columns}


def write_stages(documents: DataFrame, path: str) -> list[str]:
    """Those tables, and the plans as JSON text where there are any, as Parquet under a folder."""
    tables = stage_tables(documents) | ({"plans": plan_json(documents)} if "plan" in documents.columns else {})
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return sorted(tables)


def _named(documents: DataFrame, prefix: str) -> DataFrame:
    """Rendered documents (filename, text) under names of their own; one that has no chunks has no row.

    The name is that of the document without its suffix. Where several come to one name, each has
    the beginning of a digest of its id added.
    """
    stem = F.concat(F.lit(prefix), F.regexp_replace("filename", r"\.[^.]*$", ""))
    rows = documents.where(F.size("chunks") > 0).select("doc_id", stem.alias("stem"), "chunks")
    shared = rows.groupBy("stem").count().where("count > 1").select("stem", F.lit(True).alias("shared"))
    mark = F.when(F.col("shared"), F.concat(F.lit("_"), F.left(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(8)))).otherwise("")
    return rows.join(shared, "stem", "left").select(F.concat("stem", mark, F.lit(".md")).alias("filename"), markdown(F.col("chunks")).alias("text"))


def write_markdown(documents: DataFrame, path: str, prefix: str = FILE_PREFIX) -> str:
    """Rendered documents as a table of (filename, text) in JSON, which works on any store.

    :func:`export_markdown` makes a file of each.
    """
    _named(documents, prefix).write.mode("overwrite").json(path)
    return path


def export_markdown(documents: DataFrame, directory: str, prefix: str = FILE_PREFIX) -> list[str]:
    """A Markdown file per document, written by the executors into a folder that all machines see.

    Returns the files' paths. A file is complete or not there: it is written beside its place and moved.
    """
    os.makedirs(directory, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for name, text in zip(rows["filename"], rows["text"]):
                target = os.path.join(directory, name)
                beside = f"{target}.{os.getpid()}"
                with open(beside, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(beside, target)
                made.append(target)
            yield pd.DataFrame({"path": made}, dtype="object")

    return [r["path"] for r in _named(documents, prefix).mapInPandas(write, "path string").toLocalIterator()]


def write_chunks(documents: DataFrame, path: str, form: str = "parquet") -> None:
    """A row per chunk, as Parquet or JSON, partitioned by file type."""
    documents.select("doc_id", "filename", "file_type", F.inline("chunks")).write.mode("overwrite").partitionBy("file_type").format(form).save(path)


def write_calls(calls: DataFrame, path: str, run_id: str) -> None:
    """Model calls as JSON lines, after a header row for the run."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows = calls.select(F.lit("llm_call").alias("type"), F.lit(run_id).alias("run_id"), stamp.alias("timestamp"), "doc_id", "kind", "prompt", "system_prompt", F.col("content").alias("response"), "tokens_used", "success", "error")
    head = calls.sparkSession.range(1).select(F.lit("run_start").alias("type"), F.lit(run_id).alias("run_id"), stamp.alias("timestamp"))
    head.unionByName(rows, allowMissingColumns=True).write.mode("append").json(path)


def plan_json(documents: DataFrame) -> DataFrame:
    """Each document's granularity plan as indented JSON."""
    return documents.where("plan is not null").select("doc_id", F.to_json("plan", {"pretty": "true"}).alias("plan"))


def metadata_json(metadata: Column) -> Column:
    return F.to_json(metadata)


def metadata_from_json(text: Column) -> Column:
    """Metadata read back; what is absent gets its default."""
    m = F.from_json(text, METADATA)
    empty = F.array().cast("array<string>")
    return F.when(m.isNotNull(), F.struct(
        *[F.coalesce(m[k], F.lit("")).alias(k) for k in ("chunk_id", "title", "summary")], F.coalesce(m["intent"], F.lit("unknown")).alias("intent"),
        *[F.coalesce(m[k], empty).alias(k) for k in ("questions", "keywords")], F.coalesce(m["parent_section"], F.lit("")).alias("parent_section"),
        F.coalesce(m["token_count"], F.lit(0)).alias("token_count"),
    ))
