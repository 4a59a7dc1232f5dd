"""What a language model replies, read as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import keyword_list, none, question_lines
from .text import let, strip


def json_body(reply: Column) -> Column:
    """The reply without white space around it; if it starts with a code fence, the first fenced body."""
    fenced = F.regexp_extract(reply, r"```[a-zA-Z]*[\t-\r\x20]*([\s\S]*?)```", 1)
    return let(strip(reply), lambda r: F.when(r.startswith("```"), strip(fenced)).otherwise(r))


def json_object(reply: Column) -> Column:
    """The reply's JSON if it is an object, else null."""
    return let(json_body(reply), lambda b: F.when(F.get_json_object(b, "$").isNotNull() & F.json_object_keys(b).isNotNull(), b))


def _strings(body: Column, key: str, of_text) -> Column:
    """A list of texts under a key: its string items, or what ``of_text`` makes of a single text."""
    raw = F.get_json_object(body, f"$.{key}")
    items = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), none()).when(raw.startswith("["), F.coalesce(F.filter(items, lambda x: x.isNotNull()), none())).otherwise(of_text(raw))


def boundary_answer(reply: Column) -> Column:
    """(ok, verdict, reason, confidence) of a reply on a boundary."""

    def of(body: Column) -> Column:
        confidence = F.get_json_object(body, "$.confidence")
        usable = confidence.isNull() | confidence.try_cast("double").isNotNull()
        return F.struct(
            F.coalesce(body.isNotNull() & usable, F.lit(False)).alias("ok"), F.get_json_object(body, "$.verdict").alias("verdict"),
            F.get_json_object(body, "$.reason").alias("reason"), confidence.try_cast("double").alias("confidence"),
        )

    return let(json_object(reply), of)


def chunk_answer(reply: Column) -> Column:
    """(ok, title, summary, intent, questions, keywords) of a reply on a chunk."""

    def of(body: Column) -> Column:
        return F.struct(
            body.isNotNull().alias("ok"), *[F.get_json_object(body, f"$.{k}").alias(k) for k in ("title", "summary", "intent")],
            _strings(body, "questions", question_lines).alias("questions"), _strings(body, "keywords", keyword_list).alias("keywords"),
        )

    return let(json_object(reply), of)
