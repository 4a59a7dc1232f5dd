"""Chunking files as they arrive: a document comes whole, so each micro-batch runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Chunker
from ..sources.registry import REGISTRY, Registry


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str, chunker: Chunker, registry: Registry = REGISTRY, once: bool = False) -> StreamingQuery:
    """Chunks of every new file under ``source``, as Parquet under ``target``.

    A batch writes to a folder named by its number, so that a batch which is run again after a
    failure replaces what it wrote. ``once`` works off what is there and stops.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(source)

    def write(batch: DataFrame, number: int) -> None:
        result = chunker.run(registry.parse(batch.select("path", "content")))
        rows = result.documents.select("doc_id", "filename", "file_type", F.inline("chunks"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
