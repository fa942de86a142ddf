"""The index as tables: keywords of chunks, their stems, propagation between neighbours, postings and statistics.

A chunk's own keywords are one row, made where its text is. Beside them are posting lists of single keywords: a row for a keyword in a block of
chunks, so that shuffles move a row for many postings. doc_keywords(segment_id, chunk_idx, keyword, tf, pos, stem, origin) and
postings(segment_id, stem, chunk_idx) are views of these. Segments do not see each other: all frequencies are of one segment, so one that is
built alone equals its part of a joint build.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.porter import stem, with_stems
from ..sources.scratch import tidy
from .chunking import BLOCK_BITS

KEY = ["segment_id", "chunk_idx"]


def by_chunk(df: DataFrame) -> DataFrame:
    """The rows of a chunk in one task; what is grouped or ordered inside chunks after it moves nothing more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def with_segment(chunk_table: DataFrame) -> DataFrame:
    return chunk_table if "segment_id" in chunk_table.columns else chunk_table.withColumn("segment_id", F.lit(0))


WORD = re.compile("[A-Za-z0-9]+")
TOGETHER = 2048  # chunks whose posting lists are made at once in a task
KEPT = 1 << 19  # words that a task knows about
GIVEN = 128  # chunks in a batch that a task gives back


class _Known(dict):
    """What a function gives for words, each found once while it is kept."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, word: str):
        self[word] = out = self.f(word)
        return out


def _is_keyword(w: str) -> bool:
    """functions.text.tokens() of a word."""
    return w not in C.STOP_WORDS and (C.WORD_LEAST <= len(w) <= C.WORD_MOST or (len(w) == 2 and w in C.SHORT_WORDS))


def _ranked_keywords(text: str | None, is_keyword: dict, with_bigrams: bool) -> tuple[list[str], Counter]:
    """All words and the 50 commonest bigrams of a text by tf, then keyword, and their tf. Lowering comes after the match, as in functions.text."""
    toks = [w for w in " ".join(WORD.findall(text or "")).lower().split(" ") if is_keyword[w]]
    tf = Counter(toks)
    if with_bigrams:
        pairs = Counter(zip(toks, toks[1:]))
        often = {f"{a}_{b}": n for (a, b), n in pairs.items() if n > 1 and len(a) + len(b) < C.BIGRAM_MOST_LENGTH}
        best = sorted(sorted(often), key=often.__getitem__, reverse=True)[: C.BIGRAMS_PER_CHUNK]
        tf.update({w: often[w] for w in best})
        if len(best) < C.BIGRAMS_PER_CHUNK:
            once = (f"{a}_{b}" for (a, b), n in pairs.items() if n == 1 and len(a) + len(b) < C.BIGRAM_MOST_LENGTH)
            tf.update(dict.fromkeys(nsmallest(C.BIGRAMS_PER_CHUNK - len(best), once), 1))
    return sorted(sorted(tf), key=tf.__getitem__, reverse=True), tf


def _lists(segments: list, chunks: list, offsets: list, keywords: list, stems: list, firsts: list) -> tuple:
    """segment, block, keyword, stem, first, chunks: the postings of some chunks by (segment, block, keyword, first)."""
    size = np.diff(offsets)
    where, part = np.unique(np.array([segments, np.array(chunks) >> BLOCK_BITS], dtype=np.int64), axis=1, return_inverse=True)
    known = pa.array(keywords, pa.string()).dictionary_encode()
    key = (np.repeat(part.reshape(-1), size) * max(len(known.dictionary), 1) + known.indices.to_numpy()) * 2 + np.array(firsts, dtype=np.int64)
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    heads = order[begin]
    at = np.repeat(part.reshape(-1), size)[heads]
    lists = pa.ListArray.from_arrays(np.append(begin, len(order)).astype(np.int32), pa.array(np.repeat(np.array(chunks, dtype=np.int64), size)[order]))
    take = pa.array(heads)
    return where[0][at], where[1][at], known.take(take).dictionary_decode(), pa.array(stems, pa.string()).take(take), pa.array(firsts, pa.bool_()).take(take), lists


def _keyworded(chunk_table: DataFrame, lists: bool, with_bigrams: bool = True) -> DataFrame:
    """segment_id, chunk_idx, kw: a chunk's own keywords by tf, then keyword. Or as posting lists: segment_id, block, keyword, stem, first, chunks.

    first: of the chunk's words with one stem the one that stands for it. Bigrams never are.
    """
    c = with_segment(chunk_table).select(*KEY, "text")
    kind = c.schema["segment_id"].dataType.simpleString()
    number = pa.int64() if kind == "bigint" else pa.int32()
    entry = pa.struct([("keyword", pa.string()), ("tf", pa.int32()), ("stem", pa.string())])

    def ranked(part: pa.RecordBatch, is_keyword: dict, stem_of: dict) -> tuple[list[int], list[str], list[int], list[str], list[bool]]:
        """How many keywords each chunk has, and of all the keyword, tf, stem and whether it is first."""
        size, keywords, tf, stems, firsts = [], [], [], [], []
        for text in part.column(2):
            words, n = _ranked_keywords(text.as_py(), is_keyword, with_bigrams)
            of = [stem_of[w] for w in words]
            if lists:
                first = [False] * len(of)
                for i in {x: i for i, x in zip(range(len(of) - 1, -1, -1), reversed(of)) if "_" not in x}.values():
                    first[i] = True
                firsts += first
            else:
                tf += [min(n[w], C.TF_MOST) for w in words]
            size.append(len(words))
            keywords += words
            stems += of
        for known in (is_keyword, stem_of):
            if len(known) > KEPT:
                known.clear()
        return size, keywords, tf, stems, firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_keyword, stem_of = _Known(_is_keyword), _Known(stem)
        for b in batches:
            step = TOGETHER if lists else GIVEN
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                size, keywords, tf, stems, firsts = ranked(part, is_keyword, stem_of)
                ends = np.cumsum([0, *size])
                if not lists:
                    flat = pa.StructArray.from_arrays([pa.array(keywords, pa.string()), pa.array(tf, pa.int32()), pa.array(stems, pa.string())], fields=list(entry))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["segment_id", "chunk_idx", "kw"])
                elif keywords:
                    seg, block, word, of, first, at = _lists(part.column(0).to_pylist(), part.column(1).to_pylist(), ends, keywords, stems, firsts)
                    made = pa.RecordBatch.from_arrays([pa.array(seg, number), pa.array(block), word, of, first, at], ["segment_id", "block", "keyword", "stem", "first", "chunks"])
                    for x in range(0, made.num_rows, 1 << 16):
                        yield made.slice(x, 1 << 16)

    if lists:
        return c.mapInArrow(run, f"segment_id {kind}, block long, keyword string, stem string, first boolean, chunks array<long>")
    return c.mapInArrow(run, f"segment_id {kind}, chunk_idx long, kw array<struct<keyword: string, tf: int, stem: string>>")


def _entries(own: DataFrame) -> DataFrame:
    """segment_id, chunk_idx, keyword, tf, pos, stem of chunks with kw."""
    return own.select(*KEY, F.posexplode("kw").alias("i", "e")).select(*KEY, "e.keyword", "e.tf", (F.col("i") + 1).alias("pos"), "e.stem")


def chunk_keywords(chunk_table: DataFrame, with_bigrams: bool = True) -> DataFrame:
    """segment_id, chunk_idx, keyword, tf, pos (rank in the chunk by tf, then keyword); at most 50 bigrams a chunk."""
    return _entries(_keyworded(chunk_table, False, with_bigrams)).drop("stem")


def keyword_df(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("segment_id", "keyword").agg(F.count("*").alias("df"))


def segment_sizes(chunk_table: DataFrame) -> DataFrame:
    """segment_id, n_chunks: a row for each segment, small enough to be sent to all tasks."""
    return F.broadcast(with_segment(chunk_table).groupBy("segment_id").agg(F.count("*").alias("n_chunks")))


def propagate(keywords: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Adds to each chunk the 5 rarest single words of the chunks before and after it in its file, if it lacks them, with tf 1.

    Adds the column origin: own, prev or next (prev wins). Ranks go on after the chunk's own keywords.
    """
    with_df = keywords.join(keyword_df(keywords), ["segment_id", "keyword"])
    return keywords.withColumn("origin", F.lit("own")).unionByName(added_by_neighbours(with_df, chunk_table))


def added_by_neighbours(keywords: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """What propagate() adds; keywords have their df. Columns besides these are those of the keyword in its own chunk."""
    c = with_segment(chunk_table).select(*KEY, "source_file")
    more = [x for x in keywords.columns if x not in (*KEY, "keyword", "tf", "pos", "df")]
    keywords = by_chunk(keywords)
    scored = keywords.where(~F.col("keyword").contains("_")).join(segment_sizes(c), "segment_id")
    scored = scored.withColumn("idf", F.log(F.col("n_chunks") / (1 + F.col("df"))))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("idf"), "keyword"))).where(F.col("r") <= C.NEIGHBOUR_KEYWORDS).join(c, KEY)
    moved = None
    for shift, origin in ((1, "prev"), (-1, "next")):
        part = top.select("segment_id", (F.col("chunk_idx") + shift).alias("chunk_idx"), "source_file", "keyword", F.lit(origin).alias("origin"), "r", *more)
        moved = part if moved is None else moved.unionByName(part)
    moved = moved.join(c, [*KEY, "source_file"]).join(keywords.select(*KEY, "keyword"), [*KEY, "keyword"], "left_anti")
    first = moved.groupBy(*KEY, "keyword").agg(F.min_by(F.struct("origin", "r", *more), F.when(F.col("origin") == "prev", 0).otherwise(1)).alias("o"))
    size = keywords.groupBy(*KEY).agg(F.max("pos").alias("own"))
    order = Window.partitionBy(*KEY).orderBy(F.when(F.col("o.origin") == "prev", 0).otherwise(1), "o.r", "keyword")
    first = first.withColumn("k", F.row_number().over(order)).join(size, KEY, "left")
    return first.select(*KEY, "keyword", F.lit(1).alias("tf"), (F.coalesce("own", F.lit(0)) + F.col("k")).alias("pos"), F.col("o.origin").alias("origin"), *[F.col(f"o.{x}").alias(x) for x in more])


def block_of(chunk: Column) -> Column:
    return F.shiftright(chunk, BLOCK_BITS)


def is_bigram(keyword: Column) -> Column:
    return keyword.contains("_")


def _rarest(lists: DataFrame) -> DataFrame:
    """segment_id, chunk_idx, own (how many keywords it has), top (its 5 rarest single words, in order), from posting lists with df; a block of chunks at a time."""
    kind = lists.schema["segment_id"].dataType.simpleString()
    entry = pa.struct([("keyword", pa.string()), ("stem", pa.string())])

    def rank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.compute.sort_indices(table, [("df", "ascending"), ("keyword", "ascending")]))
        lists = table.column("chunks").combine_chunks()
        row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        every, at, own = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        single = ~pa.compute.match_substring(table.column("keyword"), "_").to_numpy(zero_copy_only=False)[row]
        row, at = row[single], at[single]
        order = np.argsort(at, kind="stable")  # by chunk; inside it words stay by df
        size = np.bincount(at, minlength=len(every))
        begin = np.cumsum(size) - size
        best = order[np.arange(len(order)) - np.repeat(begin, size) < C.NEIGHBOUR_KEYWORDS]
        words = table.select(["keyword", "stem"]).take(pa.array(row[best])).combine_chunks()
        top = pa.StructArray.from_arrays([words.column(n).combine_chunks() if isinstance(words.column(n), pa.ChunkedArray) else words.column(n) for n in ("keyword", "stem")], fields=list(entry))
        ends = np.append(0, np.cumsum(np.minimum(size, C.NEIGHBOUR_KEYWORDS)))
        return pa.table({"segment_id": pa.array(np.repeat(table.column("segment_id")[0].as_py(), len(every)), table.schema.field("segment_id").type), "chunk_idx": every, "own": own.astype(np.int64), "top": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), top)})

    return lists.select("segment_id", "block", "keyword", "stem", "df", "chunks").groupBy("segment_id", "block").applyInArrow(rank, f"segment_id {kind}, chunk_idx long, own long, top array<struct<keyword: string, stem: string>>")


def _added(rare: DataFrame, lists: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """What propagate() adds: segment_id, chunk_idx, keyword, tf, pos, stem, origin, first. Whether a chunk has a word is asked of the lists of its block."""
    c = chunk_table.select(*KEY, "source_file")
    ways = F.explode(F.array(*[F.struct(F.lit(shift).alias("by"), F.lit(origin).alias("origin")) for shift, origin in ((1, "prev"), (-1, "next"))]))
    top = rare.join(c, KEY).select("segment_id", "chunk_idx", "source_file", "top", ways.alias("w"))
    moved = top.select("segment_id", (F.col("chunk_idx") + F.col("w.by")).alias("chunk_idx"), "source_file", "w.origin", F.posexplode("top").alias("r", "e")).join(c, [*KEY, "source_file"])
    side = F.when(F.col("origin") == "prev", 0).otherwise(1)
    once = moved.groupBy(*KEY, F.col("e.keyword").alias("keyword"), F.col("e.stem").alias("stem")).agg(F.min_by(F.struct("origin", "r"), side).alias("o")).withColumn("block", block_of(F.col("chunk_idx")))
    known = lists.where(~is_bigram(F.col("keyword"))).select("segment_id", "block", "stem", F.col("keyword").alias("other"), "chunks")
    has = F.coalesce(F.array_contains("chunks", F.col("chunk_idx")), F.lit(False))
    asked = once.join(known, ["segment_id", "block", "stem"], "left").groupBy(*KEY, "keyword", "stem", "o").agg(F.max(has & (F.col("other") == F.col("keyword"))).alias("has_word"), F.max(has).alias("has_stem"))
    fresh = asked.where(~F.coalesce("has_word", F.lit(False))).join(rare.select(*KEY, "own"), KEY, "left")  # no own keyword, no row
    fresh = fresh.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.when(F.col("o.origin") == "prev", 0).otherwise(1), "o.r", "keyword")))
    first = ~F.col("has_stem") & (F.row_number().over(Window.partitionBy(*KEY, "stem").orderBy("k")) == 1)
    return fresh.select(*KEY, "keyword", F.lit(1).alias("tf"), (F.coalesce("own", F.lit(0)) + F.col("k")).cast("int").alias("pos"), "stem", F.col("o.origin").alias("origin"), first.alias("first"))


def ranked_by_tf2idf(keywords: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Adds kw_rank: by tf squared times idf, with document frequencies as they are now; ties keep their place."""
    k = keywords.join(keyword_df(keywords), ["segment_id", "keyword"]).join(segment_sizes(chunk_table), "segment_id")
    score = F.col("tf") * F.col("tf") * (F.log(F.col("n_chunks")) - F.log1p("df"))
    k = k.withColumn("tf2idf", score)
    return k.withColumn("kw_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.round("tf2idf", 9)), "pos"))).drop("n_chunks")


def capped(ranked: DataFrame, cap: int = C.KEYWORD_CAP, rank: str = "kw_rank") -> DataFrame:
    return ranked.where(F.col(rank) <= cap)


def without_hapax_bigrams(keywords: DataFrame) -> DataFrame:
    return keywords.join(keyword_df(keywords), ["segment_id", "keyword"]).where(~((F.col("df") <= 1) & F.col("keyword").contains("_"))).drop("df")


def postings(doc_keywords: DataFrame) -> DataFrame:
    """segment_id, stem, chunk_idx, each once; bigrams that only one chunk of the segment has are left out."""
    return without_hapax_bigrams(doc_keywords).select("segment_id", "stem", "chunk_idx").distinct()


def stem_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("segment_id", "stem").agg(F.count("*").alias("df"))


def doc_stats(doc_keywords: DataFrame) -> DataFrame:
    """dl: all keywords of a chunk, with bigrams and propagated ones."""
    return doc_keywords.groupBy(*KEY).agg(F.count("*").alias("dl"))


def segment_stats(chunk_table: DataFrame, stats: DataFrame) -> DataFrame:
    c = with_segment(chunk_table).select(*KEY).join(stats, KEY, "left")
    return c.groupBy("segment_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))


def chapter_signatures(chunk_table: DataFrame, keywords: DataFrame) -> DataFrame:
    """chapter_code, source_file, chunk_count, first_chunk, last_chunk, signature (the 64 words in most of its chunks)."""
    c = chunk_table.groupBy("chapter_code", "source_file").agg(F.count("*").alias("chunk_count"), F.min("chunk_idx").alias("first_chunk"), F.max("chunk_idx").alias("last_chunk"))
    k = keywords.where(~F.col("keyword").contains("_")).join(chunk_table.select("chunk_idx", "chapter_code"), "chunk_idx").groupBy("chapter_code", "keyword").agg(F.count("*").alias("freq"))
    k = k.withColumn("r", F.row_number().over(Window.partitionBy("chapter_code").orderBy(F.desc("freq"), "keyword"))).where(F.col("r") <= C.SIGNATURE_SIZE)
    s = k.groupBy("chapter_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "keyword"))), lambda x: x["keyword"]).alias("signature"))
    return c.join(s, "chapter_code", "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))


class Index:
    """The tables of an index. build() only plans them; create() writes them as parquet, plan() each when it is first asked for, and read() takes them up."""

    TABLES = ("chunks", "doc_keywords", "postings", "stem_stats", "doc_stats", "segment_stats")
    STORED = ("chunks", "own", "lists", "rare", "added", "stem_stats", "doc_stats", "segment_stats")

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)

    def __getattr__(self, name: str) -> DataFrame:
        make = self.__dict__.get("_make", {}).get(name)
        if make is None:
            raise AttributeError(name)
        return self.__dict__.setdefault(name, make())

    def has(self, name: str) -> bool:
        return name in self.__dict__ or name in self.__dict__.get("_make", {})

    @classmethod
    def build(cls, chunk_table: DataFrame, with_bigrams: bool = True, propagated: bool = True) -> Index:
        chunk_table = with_segment(chunk_table)
        keywords = chunk_keywords(chunk_table, with_bigrams)
        keywords = propagate(keywords, chunk_table) if propagated else keywords.withColumn("origin", F.lit("own"))
        dk = with_stems(keywords)
        post = postings(dk)
        stats = doc_stats(dk)
        return cls(chunks=chunk_table, doc_keywords=dk, postings=post, stem_stats=stem_stats(post), doc_stats=stats, segment_stats=segment_stats(chunk_table, stats))

    def _views(self) -> Index:
        """doc_keywords, postings and posting_lists (segment_id, stem, block, chunks; no chunk twice for a stem) of what is stored."""

        def doc_keywords() -> DataFrame:
            return _entries(self.own).withColumn("origin", F.lit("own")).unionByName(self.added.drop("first"))

        def posting_lists() -> DataFrame:
            pair = is_bigram(F.col("keyword"))  # neighbours add single words only, so df of bigrams is that of own keywords
            words = self.lists.where(~pair & F.col("first")).select("segment_id", "stem", "block", "chunks")
            pairs = self.lists.where(pair & (F.col("df") > 1)).groupBy("segment_id", "stem", "block").agg(F.array_distinct(F.flatten(F.collect_list("chunks"))).alias("chunks"))
            more = self.added.where("first").select("segment_id", "stem", block_of(F.col("chunk_idx")).alias("block"), F.array("chunk_idx").alias("chunks"))
            return words.unionByName(pairs).unionByName(more)

        self.__dict__.setdefault("_make", {}).update(doc_keywords=doc_keywords, posting_lists=posting_lists, postings=lambda: self.posting_lists.select("segment_id", "stem", F.explode("chunks").alias("chunk_idx")))
        return self

    @classmethod
    def plan(cls, chunk_table: DataFrame, path: str, segment: int | None = None) -> Index:
        """The index as parquet under path, each table written when it is first asked for. With a segment, only its partition of each table is written, over
        what it held.
        """
        spark, i = chunk_table.sparkSession, cls()

        def write(df: DataFrame, name: str) -> DataFrame:
            if segment is None:
                with tidy(spark):
                    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
                return spark.read.schema(df.schema).parquet(f"{path}/{name}")
            part = f"{path}/{name}/segment_id={segment}"
            with tidy(spark):
                df.drop("segment_id").write.mode("overwrite").option("compression", "zstd").parquet(part)
            return spark.read.parquet(part).withColumn("segment_id", F.lit(segment)).select(*df.columns)

        def lists() -> DataFrame:
            df = F.sum(F.size("chunks")).over(Window.partitionBy("stem", "segment_id", "keyword"))
            return _keyworded(i.chunks, True).repartition("stem").withColumn("df", df)

        def dl() -> DataFrame:
            n = i.rare.select(*KEY, F.col("own").alias("dl")).unionByName(i.added.groupBy(*KEY).agg(F.count("*").alias("dl")))
            return n.groupBy(*KEY).agg(F.sum("dl").alias("dl"))

        def stems() -> DataFrame:
            return i.posting_lists.groupBy("segment_id", "stem").agg(F.sum(F.size("chunks").cast("long")).alias("df"))

        i._make = {
            "chunks": lambda: write(with_segment(chunk_table), "chunks"),
            "own": lambda: write(_keyworded(i.chunks, False), "own"),
            "lists": lambda: write(lists(), "lists"),
            "rare": lambda: write(_rarest(i.lists), "rare"),
            "added": lambda: write(_added(i.rare, i.lists, i.chunks), "added"),
            "stem_stats": lambda: write(stems(), "stem_stats"),
            "doc_stats": lambda: write(dl(), "doc_stats"),
            "segment_stats": lambda: write(segment_stats(i.chunks, i.doc_stats), "segment_stats"),
        }
        return i._views()

    @classmethod
    def create(cls, chunk_table: DataFrame, path: str, segment: int | None = None) -> Index:
        """plan(), with all tables written now."""
        i = cls.plan(chunk_table, path, segment)
        for name in cls.STORED:
            getattr(i, name)
        return i

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(**{t: spark.read.parquet(f"{path}/{t}") for t in cls.STORED})._views()
