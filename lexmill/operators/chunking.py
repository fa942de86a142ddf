"""From files to chunks: whole paragraphs packed greedily up to a number of bytes.

A file is a set of paragraph rows (file, pos, p) and never one string, so a file of any size is spread over tasks; only the
greedy packing, an ordered fold, sees a whole file, and of it only the paragraphs' sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..sources.scratch import shared_folder, tidy

BREAK = "\n\n"
BLOCK_BITS = 8  # 256 chunks are a block: what is kept together in files and posting lists


def paragraphs(files: DataFrame) -> DataFrame:
    """file, major, minor, p of files (file, text): what stands between blank lines. pos is (major, minor)."""
    return files.select("file", F.lit(0).cast("long").alias("major"), F.posexplode(F.split(F.coalesce("text", F.lit("")), BREAK)).alias("minor", "p"))


def source_paragraphs(documents: DataFrame) -> DataFrame:
    """The same of a table of documents: those of a source, in the order of doc_id with blank lines between, are a file."""
    return documents.select(F.concat("source", F.lit(".txt")).alias("file"), F.col("doc_id").alias("major"), F.posexplode(F.split(F.coalesce("text", F.lit("")), BREAK)).alias("minor", "p"))


def _pack(size: np.ndarray, blank: np.ndarray, limit: int) -> np.ndarray:
    """The chunk of each paragraph from 1, 0 for blank ones between chunks. A chunk's span counts the blank ones inside."""
    out = np.zeros(len(size), dtype=np.int64)
    ends, sizes = np.cumsum(size).tolist(), size.tolist()
    begin, n, end, before = 0, 0, 0, -1
    for i in np.flatnonzero(~blank).tolist():
        if n and end - begin + sizes[i] <= limit:
            if i - before > 1:
                out[before + 1 : i] = n
        else:
            n += 1
            begin = ends[i] - sizes[i]
        out[i], end, before = n, ends[i], i
    return out


PLACE = ["file", "major", "minor", "hash"]


def _hashed(par: DataFrame) -> DataFrame:
    """Tells different paragraphs in one place (of documents under one id) apart."""
    return par.withColumn("hash", F.xxhash64("p"))


def placed(par: DataFrame, limit: int = C.CHUNK_BYTES, blanks: bool = True) -> DataFrame:
    """The chunk of each paragraph, made of their sizes alone, and what its sizes say about the chunk and the file.

    PLACE, n; copies: how often this paragraph is in this place and chunk, several: whether it is there more than once in all; last of the file; head: the
    chunk's first row; token_start (in the file) and tokens of the chunk; k, file_size and file_tokens of the file. Without blanks, blank paragraphs
    inside a chunk count for its span but aren't part of its text.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["major", "minor", "hash"], kind="stable")
        size, blank = pdf["size"].to_numpy() + len(BREAK), pdf["blank"].to_numpy()
        size[-1] -= len(BREAK)
        n = _pack(size, blank, limit)
        kept = (n > 0) if blanks else (n > 0) & ~blank
        k = int(n.max(initial=0))
        tokens = np.bincount(n[kept], weights=size[kept], minlength=k + 1).astype(np.int64) // C.BYTES_PER_TOKEN
        ends = np.cumsum(tokens)
        pdf = pdf.assign(n=n, copies=1, several=False, last=np.arange(len(pdf)) == len(pdf) - 1)[kept]
        key = ["major", "minor", "hash"]
        if (again := pdf.duplicated(key, keep=False)).any():
            pdf["several"] = again
            pdf["copies"] = pdf.groupby([*key, "n"])["copies"].transform("sum")
            pdf["last"] = pdf.groupby([*key, "n"])["last"].transform("max")
            pdf = pdf.drop_duplicates([*key, "n"])
        n = pdf["n"].to_numpy()
        pdf = pdf.assign(head=~pdf["n"].duplicated().to_numpy(), token_start=(ends - tokens)[n], tokens=tokens[n], k=k, file_size=int(size.sum()), file_tokens=int(ends[-1]))
        return pdf[[*PLACE, "n", "copies", "several", "last", "head", "token_start", "tokens", "k", "file_size", "file_tokens"]]

    sizes = _hashed(par).select(*PLACE, F.octet_length("p").cast("long").alias("size"), (~F.col("p").rlike(r"[^\n \t]")).alias("blank"))
    sizes = sizes.repartition(int(par.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")  # few bytes, but much to do for each
    return sizes.groupBy("file").applyInPandas(pack, "file string, major long, minor int, hash long, n long, copies long, several boolean, last boolean, head boolean, token_start long, tokens long, k long, file_size long, file_tokens long")


def _text(parts: DataFrame) -> Column:
    """The text of a chunk of x (major, minor, hash, p, copies), several, last."""
    x = F.array_sort("x")
    once = F.transform(x, lambda e: e["p"])
    repeated = F.flatten(F.transform(F.array_distinct(x), lambda e: F.array_repeat(e["p"], e["copies"].cast("int"))))
    return F.concat(F.array_join(F.when(F.col("several"), repeated).otherwise(once), BREAK), F.when(F.col("last"), F.lit("")).otherwise(F.lit(BREAK)))


def _joined(par: DataFrame, places: DataFrame, by: list[str], *more: str) -> DataFrame:
    """A row for each group of `by` with its text and the first value of `more`."""
    x = _hashed(par).join(places, PLACE)
    if by[0] == "block":
        x = x.repartition("block")  # the chunks of a block in one task, so that they are neighbours where they are written
    parts = x.groupBy(*by).agg(F.collect_list(F.struct("major", "minor", "hash", "p", "copies")).alias("x"), F.max("several").alias("several"), F.max("last").alias("last"), *[F.first(m).alias(m) for m in more])
    return parts.select(*by, *more, _text(parts).alias("text"))


def chunk_paragraphs(par: DataFrame, limit: int = C.CHUNK_BYTES, blanks: bool = True) -> DataFrame:
    """file, n (from 1), text, file_size. Files without a paragraph give no chunk; a paragraph over the limit is a chunk of its own."""
    places = placed(par, limit, blanks).select(*PLACE, "n", "copies", "several", "last", "file_size")
    return _joined(par, places, ["file", "n"], "file_size").select("file", "n", "text", "file_size")


def chapter_codes(files: DataFrame) -> DataFrame:
    """file, chapter_code of (file, file_size): the code of its name; files with the same code get 2, 3, ... behind it, by size and name.

    A numbered code that is another file's own gets an x. A row for each file: small against the text.
    """
    f = files.select("file", T.chapter_code(F.regexp_extract("file", r"([^/]*)$", 1)).alias("base"), "file_size")
    f = f.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("file_size", "file")))
    f = f.withColumn("code", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.col("k").cast("string"))))
    own = f.select(F.col("base").alias("code")).distinct().withColumn("own", F.lit(True))
    f = f.join(own, "code", "left")
    return f.select("file", F.when((F.col("k") > 1) & F.col("own"), F.concat("code", F.lit("x"))).otherwise(F.col("code")).alias("chapter_code"))


def _outline(places: DataFrame) -> DataFrame:
    heads = places.where("head")
    files = heads.where("n = 1").select("file", "file_size", "k", "file_tokens")
    before = Window.orderBy("file_size", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = files.select("file", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("first_token"))
    c = heads.select("file", "n", "k", "token_start", "tokens").join(chapter_codes(files.select("file", "file_size")).join(offsets, "file"), "file")
    name = lambda n: F.format_string("%s_%03d", "chapter_code", n)
    start = F.col("first_token") + F.col("token_start")
    return c.select(
        (F.col("first") + F.col("n") - 1).alias("chunk_idx"), name(F.col("n")).alias("chunk_id"), F.col("file").alias("source_file"), "chapter_code", "n",
        F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("prev_chunk_id"), F.when(F.col("n") < F.col("k"), name(F.col("n") + 1)).alias("next_chunk_id"), start.alias("token_start"), (start + F.col("tokens")).alias("token_end"),
    )


def _written_places(par: DataFrame, limit: int, blanks: bool) -> DataFrame:
    """placed() as a table: numbers for each paragraph, which are packed once and read for the outline and for the texts."""
    places = placed(par, limit, blanks)
    path = shared_folder(par.sparkSession, "places")
    with tidy(par.sparkSession):
        places.write.option("compression", "zstd").parquet(path)
    return par.sparkSession.read.schema(places.schema).parquet(path)


def outline(par: DataFrame, limit: int = C.CHUNK_BYTES, blanks: bool = True) -> DataFrame:
    """The chunk table without summary and text: no text is moved for it."""
    return _outline(_written_places(par, limit, blanks))


def chunks(par: DataFrame, limit: int = C.CHUNK_BYTES, blanks: bool = True) -> DataFrame:
    """The chunk table: chunk_idx over all files by their size and name, ids, links inside a file, running tokens, summary, text.

    Texts are moved twice: to the places of their paragraphs, and together, a block of chunks to a task.
    """
    places = _written_places(par, limit, blanks)
    o = _outline(places)
    named = o.select(F.col("source_file").alias("file"), "n", F.shiftright("chunk_idx", BLOCK_BITS).alias("block"), "chunk_idx", F.struct(*[c for c in o.columns if c != "chunk_idx"]).alias("meta"))
    c = _joined(par, places.select(*PLACE, "n", "copies", "several", "last").join(named, ["file", "n"]).drop("n"), ["block", "chunk_idx"], "meta")
    return c.select("chunk_idx", "meta.*", T.summary(F.col("text")).alias("summary"), "text")


def token_range(chunk_table: DataFrame, skip: int, most: int, inclusive: bool = True) -> DataFrame:
    """The chunks of a range of tokens: those whose running end passes `skip`, until `most` more are reached.

    inclusive keeps the chunk that crosses the end, so that one at a border is in both ranges; else a chunk is in the range where it ends.
    """
    start, end = F.col("token_start"), F.col("token_end")
    return chunk_table.where((end > skip) & (start < skip + most if inclusive else end <= skip + most))


def segments(chunk_table: DataFrame, tokens_per_segment: int) -> DataFrame:
    """Adds segment_id: the segment where a chunk begins."""
    return chunk_table.withColumn("segment_id", F.floor(F.col("token_start") / tokens_per_segment).cast("int"))
