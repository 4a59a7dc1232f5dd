"""The corpus pipeline: five stages, each one operator, from raw documents to a training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as
Parquet in the shared folder and reads again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from passagemill.llm.common import held, materialise, release, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules hold good."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates."""
    return jaccard_join.keep_firsts(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts and all, with their places in the training order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("personal data", personal_data),
    ("source mixing", source_mix),
]

#: Expectation-maximisation, the latent space and the schedule are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, as redacted, with block, slot and place.

    What a stage held or wrote is freed when the next table is stored; the last one stays in the
    shared folder, for the caller to read.
    """
    docs = table(spark, sf_dir, "documents")
    tables, folders = len(held), len(written)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, tables, folders, keep=docs.stored)
    return docs
