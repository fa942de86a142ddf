"""Files that arrive become searchable chunks: a file stream, micro-batches appended to the chunk table and the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import chunking
from ..operators.index import Index


def ingest(files: DataFrame, path: str, batch_id: int) -> None:
    """Chunks of one micro-batch, appended as segment `batch_id` + 1 of the index at path.

    A batch writes its own partition by overwriting it, so that one that runs again after a failure doesn't add its rows twice.
    """
    c = chunking.chunk_paragraphs(chunking.paragraphs(files), C.DYNAMIC_CHUNK_BYTES)
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^A-Za-z0-9]", "_")
    c = c.withColumns({"type": T.content_type(name), "clean": clean})
    numbered = c.groupBy("file").agg(F.count("*").alias("k"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file of the micro-batch
    first = numbered.select("file", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    c = c.join(first, "file").withColumn("chunk_idx", F.col("first") + F.col("n") - 1)
    table = c.select(
        F.lit(batch_id + 1).alias("segment_id"), "chunk_idx", F.format_string("%s_%s_%d", "clean", "type", F.lit(batch_id * 10**9) + F.col("chunk_idx") + 1).alias("chunk_id"), F.col("file").alias("source_file"), F.col("n").cast("long").alias("n"),
        F.lit(0).cast("long").alias("token_start"), T.token_count(F.col("text")).alias("token_end"), T.summary(F.col("text")).alias("summary"), "text",
    )
    Index.create(table, path, batch_id + 1)


def read(spark: SparkSession, path: str) -> Index:
    """The index as it is now; call again to see later batches."""
    return Index.read(spark, path)


def stream(spark: SparkSession, source: str, path: str, checkpoint: str):
    """A running query over the .txt and .md files that come into `source`."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{txt,md}").load(source)
    files = raw.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return files.writeStream.foreachBatch(lambda df, i: ingest(df, path, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
