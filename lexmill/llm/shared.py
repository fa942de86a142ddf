"""Session helpers shared by the operators: inputs, written intermediate tables, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, local mode gets a temporary one and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may have ended; what is left is in the shared folder
        pass


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive the loss of executors.

    Each run has a folder of its own. Tables that nothing reads any more go with drop(); the folder goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))


def id_and_text(docs: DataFrame, lower: bool = False) -> DataFrame:
    """doc_id as a long and text, null text as empty; other columns are left out, and rows without doc_id too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lower(text) if lower else text).alias("text")).where("doc_id is not null")


def own_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone (one column of longs); rows without doc_id stay."""
    name = own_name(docs, "__gone")
    gone = gone.toDF(name)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices with at most `size` bytes of the column (one row at least), to bound a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + batch.num_rows + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], overlap: int, with_batch: bool = False, size: int = PIECE_BYTES) -> Iterator[tuple]:
    """Slices of batches with doc_id and text, as (ids, base, data, offsets): texts of at most `size` bytes whole, with base 0.

    A longer text comes in pieces that end between words and have `overlap` words in common; base is the number of a piece's first word.
    """
    from .kernels import buffers, cuts

    for batch in slices(batches, size=SLICE_BYTES // 2):
        data, offsets = buffers(batch.column(1))
        if batch.num_rows > 1 or len(data) <= size:
            found = (batch.column(0), 0, data, offsets)
            yield (*found, batch) if with_batch else found
            continue
        for start, stop, base in cuts(data, overlap, size):
            found = (batch.column(0), base, data[start:stop], np.array([0, stop - start]))
            yield (*found, batch) if with_batch else found
