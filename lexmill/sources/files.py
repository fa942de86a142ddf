"""Files in: text trees, JSONL manifests, originals, segments. Schemas are given, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import KEYWORD_CAP

MANIFEST = "chunk_id string, type string, source_file string, chapter_code string, code string, token_start long, token_end long, offset long, length long, compression string, summary string, prev_chunk_id string, next_chunk_id string, keywords array<string>, tf map<string,int>, timestamp long, user_message string, system_response string, source_refs array<struct<chunk_id:string,relevance_score:double,snippet:string>>, text string"
ORIGINALS = "file_id string, original_name string, category string, stored_path string, format string, chunk_ids array<string>"
REGISTRY = "segments array<struct<id:int,dir:string>>"
CODE = "version string, title string, code string, code_files struct<files:array<struct<filename:string,chunk_ids:array<string>>>>, fixes struct<entries:array<struct<fix_id:string,affected_code_chunks:array<string>>>>, features struct<entries:array<struct<feature_id:string,code_chunks:array<string>,conversation_refs:array<string>>>>, chunks struct<total:long,by_type:map<string,long>>, conversations struct<count:long,summaries:array<struct<chunk_id:string,summary:string,source_refs:array<string>>>>"


def text_files(spark: SparkSession, *dirs: str) -> DataFrame:
    """file, text of all .txt and .md files below the folders; bytes that aren't UTF-8 become the replacement character."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").load(list(dirs))
    return b.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL manifest with defaults for what lines lack, 200 keywords a line; lines that aren't JSON are left out."""
    raw = spark.read.schema(MANIFEST + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    m = raw.where("_bad is null").drop("_bad")
    filled = {c: F.coalesce(c, F.lit("")) for c in ("chunk_id", "summary", "source_file")} | {c: F.coalesce(c, F.lit(0)) for c in ("token_start", "token_end", "offset", "length", "timestamp")}
    return m.withColumns(filled).withColumn("keywords", F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, KEYWORD_CAP))


def derived_is_current(derived: str, source: str) -> bool:
    """Whether a derived table is no older than what it was made from (or this is gone)."""
    if not os.path.exists(derived):
        return False
    return not os.path.exists(source) or os.path.getmtime(derived) >= os.path.getmtime(source)


def derived_path(source: str) -> str:
    return source[: -len(".jsonl")] + ".parquet" if source.endswith(".jsonl") else source + ".parquet"


def originals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORIGINALS).option("multiLine", True).json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, dir of a registry file."""
    r = spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.explode("segments").alias("s"))
    return r.select(F.col("s.id").alias("segment_id"), F.col("s.dir").alias("dir"))


def guide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODE).option("multiLine", True).json(path)


def allowed(path: str, roots: tuple[str, ...] = ("/tmp",)) -> str:
    """The real path, if it lies in the current folder or one of `roots` and is without `..`."""
    real = os.path.realpath(path)
    inside = any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, (os.getcwd(), *roots)))
    if ".." in path.split("/") or not inside:
        raise PermissionError(path)
    return real
