"""Line dedup: a line is kept where it occurs first, by (doc_id, position), in the whole table.

The lines' hashes are range-partitioned with a secondary sort by document and position; each partition is streamed once and
marks the first row of each hash. The ranges are over (hash, doc_id, position), so that a line that occurs very often is
spread over many partitions; only the leading hash of a partition can have begun before it, and one row a partition, of
its first and last hash, settles these. The result is a keep bitmap for each document, compressed to run lengths:
"12 1 3" is 12 lines kept, 1 dropped, 3 kept; the first number is always of kept lines and may be 0.

Blank lines (white space only) are always kept. Lines are compared without white space at their ends. Null and empty
texts have one blank line. Rows without doc_id have no line order and are left out of the bitmaps; repeated rows with the
same doc_id and text are one document; different texts under one doc_id are told apart by text_hash. An empty table has no
bitmap. Of a very long text only a hash and a number for each line leave its task. bitmaps() leaves other columns out, apply() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, id_and_text, own_name, read

_BLANK = " \t\r\f\x0b"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `first`: whether the row's hash begins here; and `leads`: whether it is the first hash of the partition."""
    last, lead = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        lead = h[0] if lead is None else lead
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        first[0] = last is None or h[0] != last
        last = h[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(h == lead)], [*batch.schema.names, "first", "leads"])


def _lines(docs: DataFrame) -> DataFrame:
    d = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(_BLANK))
    return d.select(F.when(line != "", F.xxhash64(line)).alias("h"), "doc_id", "text_hash", "pos")


def marked_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, pos, keep for each line."""
    spark = docs.sparkSession
    lines = scratch.write(_lines(docs), "lines")  # read three times: for the ranges, for the rows, and for blank lines
    ordered = lines.where("h is not null").repartitionByRange("h", "doc_id", "text_hash", "pos").sortWithinPartitions("h", "doc_id", "text_hash", "pos")
    schema = "h long, doc_id long, text_hash long, pos int, first boolean, leads boolean"
    marks = scratch.write(ordered.mapInArrow(_mark, schema).withColumn("part", F.spark_partition_id()), "marks")
    ends = marks.groupBy("part").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).orderBy("part").collect()  # a row for each partition
    begun = [b.part for a, b in zip(ends, ends[1:]) if a.hi == b.lo]
    keep: Column = F.col("first")
    if begun:
        keep = keep & ~(F.col("leads") & F.col("part").isin(begun))
    blank = lines.where("h is null").select("doc_id", "text_hash", "pos", F.lit(True).alias("keep"))
    return marks.select("doc_id", "text_hash", "pos", keep.alias("keep")).unionByName(blank)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        n_lines = batch.column(3).to_numpy()
        offsets = np.asarray(lists.offsets)
        kept = np.asarray(lists.values)
        out = []
        for i, n in enumerate(n_lines):
            keep = np.zeros(n, dtype=bool)
            keep[kept[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]] = True
            cuts = np.flatnonzero(np.diff(keep.astype(np.int8))) + 1
            lengths = np.diff(np.concatenate(([0], cuts, [n])))
            out.append(" ".join(map(str, ([] if keep[0] else [0]) + lengths.tolist())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(out, pa.string())], ["doc_id", "text_hash", "n_lines", "n_kept", "keep_runs"])


def bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines, n_kept, keep_runs."""
    lines = marked_lines(docs, Scratch(docs.sparkSession, "line_dedup"))
    by = lines.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(F.col("keep"), F.col("pos"))).alias("kept"), (F.max("pos") + 1).cast("int").alias("n_lines"))
    by = by.withColumn("n_kept", F.size("kept").cast("int"))
    return by.select("doc_id", "text_hash", "kept", "n_lines", "n_kept").mapInArrow(_run_lengths, "doc_id long, text_hash long, n_lines int, n_kept int, keep_runs string")


def apply(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, with the same columns; n_chars, where there is one, is counted anew.

    A document all of whose lines are dropped goes. Documents from which nothing is dropped, and rows without doc_id, stay as they are.
    Of repeated rows with the same doc_id and text each gets the same lines.
    """
    key, text_hash, n_kept, code = (own_name(docs, n) for n in ("__id", "__hash", "__kept", "__runs"))
    found = bitmaps(docs).where("n_kept < n_lines").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("n_kept").alias(n_kept), F.col("keep_runs").alias(code))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(found, (docs["doc_id"].cast("long") == found[key]) & (F.xxhash64(text) == found[text_hash]), "left").where(F.col(code).isNull() | (F.col(n_kept) > 0))
    mask = F.flatten(F.transform(F.split(code, " "), lambda n, i: F.array_repeat(i % 2 == 0, n.cast("int"))))
    pairs = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), mask.alias("keep")), lambda x: x["keep"])
    cut = F.when(F.col(code).isNotNull(), F.array_join(F.transform(pairs, lambda x: x["line"]), "\n")).otherwise(F.col("text"))
    out = joined.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(code).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return bitmaps(read(spark, sf_dir, "documents")).drop("text_hash")


SQL = {"op8_line_dedup": r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d),
t AS (SELECT doc_id, text, pos, regexp_replace(raw, '^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$', '', 'g') AS line FROM lines),
k AS (SELECT doc_id, text, pos, line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM t),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, text, keep ORDER BY pos) AS island FROM k),
r AS (SELECT doc_id, text, keep, island, min(pos) AS began, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, sum(n)::INTEGER AS n_lines, coalesce(sum(n) FILTER (WHERE keep), 0)::INTEGER AS n_kept,
    CASE WHEN arg_min(keep, began) THEN '' ELSE '0 ' END || string_agg(n::VARCHAR, ' ' ORDER BY began) AS keep_runs
FROM r GROUP BY doc_id, text"""}
