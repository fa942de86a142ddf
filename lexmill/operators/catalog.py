"""Counts, pages and lookups over chunk metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def types(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.groupBy(T.type_of_id(F.col("chunk_id")).alias("type")).agg(F.count("*").alias("n"))


def by_source(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.groupBy("source_file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file")


def page(chunk_table: DataFrame, number: int = 0, size: int = C.PAGE_SIZE, type_: str | None = None, source: str | None = None) -> DataFrame:
    """One page of chunks in their order; sizes over 1000 count as 1000. A page is what is asked for, so a sort with offset and limit."""
    c = chunk_table
    if type_ is not None:
        c = c.where(T.type_of_id(F.col("chunk_id")) == type_)
    if source is not None:
        c = c.where(F.col("source_file") == source)
    size = min(size, C.PAGE_SIZE_MOST)
    return c.orderBy("chunk_idx").offset(number * size).limit(size)


def stats(chunk_table: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """One row: chunks, files, tokens, mean keywords of a chunk, and the k for a corpus of this size."""
    from .search import dynamic_top_k

    c = chunk_table.agg(F.count("*").alias("n_chunks"), F.countDistinct("source_file").alias("n_files"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))
    d = doc_stats.agg(F.round(F.avg("dl"), 6).alias("avgdl"))
    return c.crossJoin(d).withColumn("top_k", dynamic_top_k(F.col("n_chunks")))


def originals_of(chunk_ids: DataFrame, originals: DataFrame) -> DataFrame:
    """Each chunk with the original file it is from, if known; of several the one with the greatest file_id."""
    o = originals.select("file_id", "original_name", "category", "stored_path", "format", F.posexplode("chunk_ids").alias("p", "chunk_id"))
    last = o.groupBy("chunk_id").agg(F.max_by(F.struct("file_id", "original_name", "category", "stored_path", "format"), "file_id").alias("o"))
    return chunk_ids.join(last, "chunk_id", "left").select("chunk_id", "o.*")


MIME = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "json": "application/json", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def mime(format_column):
    c = None
    for k, v in MIME.items():
        c = F.when(F.lower(format_column) == k, v) if c is None else c.when(F.lower(format_column) == k, v)
    return c.otherwise("application/octet-stream")


def fixes_for_file(code_files: DataFrame, fixes: DataFrame, name: str) -> DataFrame:
    """Fixes that touch a chunk of a file whose name contains the text."""
    ids = code_files.where(F.col("filename").contains(name)).select(F.explode("chunk_ids").alias("chunk")).distinct()
    f = fixes.select("*", F.explode("affected_code_chunks").alias("chunk"))
    hit = f.join(ids, "chunk", "left_semi").select("fix_id").distinct()
    return fixes.join(hit, "fix_id", "left_semi")


def feature(features: DataFrame, text: str) -> DataFrame:
    """The first feature, by id, whose id contains the text."""
    return features.where(F.col("feature_id").contains(text)).orderBy("feature_id").limit(1)


def unloaded(registry: DataFrame, loaded: DataFrame) -> DataFrame:
    """Segments of the registry whose directory isn't loaded."""
    return registry.join(loaded.select("dir"), "dir", "left_anti")


def segment_offsets(segment_stats: DataFrame) -> DataFrame:
    """segment_id, n, doc_offset: where a segment's chunks begin in a common numbering (a row for each segment)."""
    w = Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    return segment_stats.select("segment_id", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("doc_offset"))


def segment_of(numbers: DataFrame, offsets: DataFrame) -> DataFrame:
    """The segment of each global chunk number: a range join with the few offsets."""
    o = F.broadcast(offsets)  # a row for each segment
    return numbers.join(o, (F.col("number") >= F.col("doc_offset")) & (F.col("number") < F.col("doc_offset") + F.col("n"))).select("number", "segment_id", (F.col("number") - F.col("doc_offset")).alias("chunk_idx"))
