"""Files out. Tables go to zstd parquet; manifests and guides to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_rows(chunk_table: DataFrame, keywords: DataFrame) -> DataFrame:
    """Lines of a manifest: chunk metadata with its keywords in order, and tf where it is over 1."""
    k = keywords.groupBy("chunk_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "keyword", "tf"))).alias("k"))
    c = chunk_table.join(k, "chunk_idx", "left")
    often = F.filter("k", lambda x: x["tf"] > 1)
    tf = F.map_from_entries(F.transform(often, lambda x: F.struct(x["keyword"], x["tf"])))
    return c.select(
        "chunk_id", F.lit("DOC").alias("type"), "source_file", "chapter_code", "token_start", "token_end", F.octet_length("text").cast("long").alias("length"), F.lit("zstd").alias("compression"), "summary",
        "prev_chunk_id", "next_chunk_id", F.coalesce(F.transform("k", lambda x: x["keyword"]), F.array().cast("array<string>")).alias("keywords"), F.when(F.size(often) > 0, tf).alias("tf"), "text",
    )


def write_manifest(chunk_table: DataFrame, keywords: DataFrame, path: str) -> None:
    manifest_rows(chunk_table, keywords).write.mode("overwrite").json(path)


def append_chunks(chunk_table: DataFrame, path: str) -> None:
    chunk_table.write.mode("append").option("compression", "zstd").parquet(path)


def convert_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Guides and catalogs: small tables, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def guide_rows(signatures: DataFrame) -> DataFrame:
    order = Window.orderBy("first_chunk", "chapter_code")  # a row for each chapter
    return signatures.withColumn("n", F.row_number().over(order)).orderBy("n").drop("n")
