"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, in regular-expression form.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The same characters, one by one.
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for null or blank text."""
    flat = F.coalesce(text, F.lit(""))
    for ch in SPACES[1:]:
        flat = F.replace(flat, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(flat, " ", -1), "")


def strip_chars(text: Column, chars) -> Column:
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, on one machine, a folder of the warehouse is used; a cluster without
    a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_passagemill"
    return base.rstrip("/")


def hold(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept on the executors, in memory or on disk.

    What a lost executor held is computed again from the input; nothing else depends on it. For
    tables that one operator reads several times; loops cut their lineage by :func:`materialise`.
    """
    held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


#: Tables kept by :func:`hold`, and folders written by :func:`materialise`, for :func:`release`.
held: list[DataFrame] = []
written: list[str] = []


def release(spark: SparkSession, tables: int, folders: int, keep: str) -> None:
    """Free what was held and written after the first so many tables and folders, but for one folder.

    For a caller that has stored its result: what is freed can't be read any more.
    """
    while len(held) > tables:
        held.pop().unpersist()
    for path in [x for x in written[folders:] if x != keep]:
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`materialise` wrote, which is its table's ``stored``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    written.remove(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors cost a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/passagemill-{label}-{uuid.uuid4().hex}"
    # No marker file: without native libraries each file that the driver makes forks its JVM.
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out
