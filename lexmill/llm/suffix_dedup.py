"""Suffix-array dedup over a logarithmic family of arrays: all word-for-word matches of MIN_WORDS words and more between documents.

Suffixes are sampled by content. Of the suffixes that begin in a stretch of MIN_WORDS words and have their first K words in it, the one of the least
fingerprint (the leftmost of equal ones) owns the stretch. It depends on the stretch alone, so equal stretches have equal owners
at the same place. Only owners are indexed, each with the successive stretches it owns: their first place, number, and a
fingerprint c of all words that they cover. An array holds the prefixes (K words) of a set of documents in the order of their fingerprints,
which brings equal prefixes together as an alphabetical order would, each with its least and greatest doc_id.

The family (`SuffixFamily`) takes documents in batches. A new batch gets its array, which is merge-scanned against the arrays that exist,
and then becomes a level; two levels of equal rank merge into one of the next, so that each prefix is rewritten log2(batches) times. All
arrays are bucketed alike by fingerprint and sorted, so scans and merges move nothing between tasks; a prefix is one
row of an array however many documents hold it. What a scan returns are the prefixes that several documents hold.

Matches are then settled among the owners of these prefixes. Owners with the same c hold the same words, so one represents them. Where a
prefix has a single c, all its stretches match. Otherwise the stretches of each c are taken from the text of its first document and
compared by fingerprint, whatever other documents hold a part of them. Either way each stretch gets its first place by (doc_id, word).

The result has a row for each run of stretches of a document whose first place is in another one: a document's membership in the
class of that place. Each pair of documents that share MIN_WORDS words is in it, directly or through the first place of these very words:
`pairs()` gives all pairs with the exact spans, which is quadratic in the size of a class and not part of the query. A passage in
thousands of documents thus gives thousands of rows and not their square.

Matches inside one document are not reported. Words are compared in lower case, without punctuation. Null, empty and short texts have no
match; very long ones are read in pieces that overlap; rows without doc_id are left out; rows that share a doc_id are one document and do not
match each other; other columns are ignored; an empty table has no match.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, grams, leftmost_least, mix, signed, word_spans, word_sums, words
from .shared import Scratch, id_and_text, pieces, read

MIN_WORDS = 50
K = 25
BATCHES = 4


def owners(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """h (of the owner's first k words), c (of all words of its stretches), doc_id, pos (of the first stretch), off (of the owner from there), n (stretches)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, base, data, offsets in pieces(it, min_words - 1):
            _, _, row, h = words(data, offsets)
            g, valid = grams(h, row, k)
            first = np.searchsorted(row, np.arange(len(offsets) - 1))
            s = len(h) - min_words + 1
            if s <= 0:
                continue
            at = leftmost_least(np.where(valid, g, ~U64(0)), min_words - k + 1)[:s]
            whole = row[:s] == row[min_words - 1 :]
            begins = whole.copy()
            begins[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
            lo = np.flatnonzero(begins)
            ends = whole.copy()
            ends[:-1] &= (at[1:] != at[:-1]) | ~whole[1:]
            n = np.flatnonzero(ends) + 1 - lo
            off = at[lo] - lo
            c = mix(word_spans(word_sums(h), lo, lo + n + min_words - 1) + off.astype(np.uint64))
            r = row[lo]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(g[at[lo]])), pa.array(signed(c)), ids.take(pa.array(r)), pa.array((lo - first[r] + base).astype(np.int32)), pa.array(off.astype(np.int16)), pa.array(n.astype(np.int16))],
                ["h", "c", "doc_id", "pos", "off", "n"],
            )

    return id_and_text(docs, lower=True).mapInArrow(run, "h long, c long, doc_id long, pos int, off short, n short")


class SuffixFamily:
    """Arrays of prefixes, h with its least and greatest doc_id (lo, hi), in levels of rank 0, 1, 2, ... with one array of a rank at most.

    They are tables of the scratch folder, bucketed by h. The number of buckets is settled when the family begins.
    """

    def __init__(self, scratch: Scratch, buckets: int | None = None):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}

    def _write(self, array: DataFrame) -> str:
        table = f"suffixes_{uuid.uuid4().hex}"
        array.write.bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").option("path", self.scratch.path(table)).saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        self.scratch.drop(table)

    def array(self, entries: DataFrame) -> str:
        """The array of new entries (h, doc_id): the only step that moves them, after they were combined in the map tasks."""
        a = entries.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        return self._write(a.repartition(self.buckets, "h"))

    def append(self, entries: DataFrame) -> DataFrame:
        """Adds a batch (h, doc_id). Returns h of the prefixes of the batch that several documents hold, here or in earlier batches."""
        new = self.array(entries)
        n = self.spark.table(new)
        found = n.where("lo != hi").select("h")
        for table in self.levels.values():
            level = self.spark.table(table).select("h", F.col("lo").alias("l"), F.col("hi").alias("u"))
            found = found.unionByName(n.join(level.hint("merge"), "h").where("least(lo, l) != greatest(hi, u)").select("h"))
        found = self.scratch.write(found, f"found-{uuid.uuid4().hex}")
        rank = 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            merged = self._merge(old, new)
            self._drop(old)
            self._drop(new)
            new, rank = merged, rank + 1
        self.levels[rank] = new
        return found

    def _merge(self, a: str, b: str) -> str:
        """The merge of two arrays: a full outer sort-merge join of equal buckets."""
        x, y = self.spark.table(a), self.spark.table(b).select("h", F.col("lo").alias("l"), F.col("hi").alias("u"))
        return self._write(x.join(y.hint("merge"), "h", "full").select("h", F.least("lo", "l").alias("lo"), F.greatest("hi", "u").alias("hi")))

    def close(self) -> None:
        for table in self.levels.values():
            self._drop(table)
        self.levels = {}


def stretches(docs: DataFrame, contexts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """c, j, w: the fingerprint of each stretch of the contexts (c, doc_id, pos, off, n), j counted from the first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"c": np.int64, "pos": np.int64, "off": np.uint64, "n": np.int64}
        for _, base, data, offsets, batch in pieces(it, 2 * min_words, with_batch=True):
            _, _, row, h = words(data, offsets)
            sums = word_sums(h)
            first = np.searchsorted(row, np.arange(len(offsets)))
            lists = batch.column(2)
            at = np.asarray(lists.offsets)
            flat = lists.flatten()
            c, pos, off, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(t) for i, t in enumerate(kinds.values()))
            r = np.repeat(np.arange(batch.num_rows), np.diff(at))
            lo = first[r] + pos - base
            inside = (pos >= base) & (lo + n + min_words - 1 <= first[r + 1])  # the rest is in another piece, or in another row of the doc_id
            c, lo, off, n = c[inside], lo[inside], off[inside], n[inside]
            same = signed(mix(word_spans(sums, lo, lo + n + min_words - 1) + off)) == c
            c, lo, n = c[same], lo[same], n[same]
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(lo, n) + j
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, n)), pa.array(j.astype(np.int16)), pa.array(signed(word_spans(sums, start, start + min_words)))], ["c", "j", "w"])

    asked = contexts.groupBy("doc_id").agg(F.collect_list(F.struct("c", "pos", "off", "n")).alias("asked"))
    return id_and_text(docs, lower=True).join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, "c long, j short, w long")


def first_places(docs: DataFrame, places: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """c, j0, j1, m_doc, m_pos: the runs of stretches j0 to j1 of each c whose first place is at m_pos, m_pos + 1, ... of document m_doc."""
    one = places.groupBy("c", "h", "off", "n").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("times"))
    contexts = scratch.write(one.select("c", "h", "off", "n", "f.doc_id", "f.pos", "times"), "contexts")
    mixed = contexts.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).select("h", (F.col("c0") != F.col("c1")).alias("mixed"))
    contexts = scratch.write(contexts.join(mixed, "h"), "contexts-of-prefixes")
    alone = contexts.where("not mixed").select("c", F.lit(0).cast("short").alias("j0"), (F.col("n") - 1).cast("short").alias("j1"), F.col("doc_id").alias("m_doc"), F.col("pos").alias("m_pos"))
    several = contexts.where("mixed")
    w = scratch.write(stretches(docs, several.select("c", "doc_id", "pos", "off", "n"), min_words), "stretches")
    w = w.join(several.select("c", "doc_id", "pos", "times"), "c").select("c", "j", "w", "doc_id", (F.col("pos") + F.col("j")).alias("pos"), "times")
    firsts = w.groupBy("w").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("w", F.col("f.doc_id").alias("m_doc"), F.col("f.pos").alias("m_pos"))
    m = w.join(firsts, "w").where("times > 1 or doc_id != m_doc").select("c", "j", "m_doc", (F.col("m_pos") - F.col("j")).alias("begin"))
    order = Window.partitionBy("c", "m_doc", "begin").orderBy("j")  # no more than the stretches of one owner
    m = m.distinct().withColumn("run", F.col("j") - F.row_number().over(order))
    runs = m.groupBy("c", "m_doc", "begin", "run").agg(F.min("j").alias("j0"), F.max("j").alias("j1"))
    return alone.unionByName(runs.select("c", "j0", "j1", "m_doc", (F.col("begin") + F.col("j0")).cast("int").alias("m_pos")))


def memberships(places: DataFrame, runs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, end_word, match_doc_id, match_start_word, n_words: runs joined where they touch on a diagonal of two documents."""
    hit = places.join(runs, "c").where("doc_id != m_doc")
    hit = hit.select("doc_id", "m_doc", (F.col("pos") + F.col("j0")).alias("a"), (F.col("pos") + F.col("j1")).alias("b"), (F.col("pos") + F.col("j0") - F.col("m_pos")).alias("shift")).distinct()
    order = Window.partitionBy("doc_id", "m_doc", "shift").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hit = hit.withColumn("new", F.coalesce(F.col("a") > before + min_words, F.lit(True)).cast("int"))
    hit = hit.withColumn("chain", F.sum("new").over(order))
    c = hit.groupBy("doc_id", "m_doc", "shift", "chain").agg(F.min("a").alias("lo"), (F.max("b") + min_words).alias("hi"))
    return c.select(
        "doc_id", F.col("lo").cast("int").alias("start_word"), F.col("hi").cast("int").alias("end_word"), F.col("m_doc").alias("match_doc_id"), (F.col("lo") - F.col("shift")).cast("int").alias("match_start_word"), (F.col("hi") - F.col("lo")).cast("int").alias("n_words")
    )


def long_matches(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, batches: int = BATCHES) -> DataFrame:
    """doc_id, start_word, end_word, match_doc_id, match_start_word, n_words. The table is taken in so many batches, by ranges of doc_id."""
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("cuts")).first().cuts if batches > 1 else []
    number = F.lit(0)
    for cut in cuts or []:
        number = number + (F.col("doc_id") > cut).cast("int")
    entries = scratch.write(owners(docs, min_words, k).withColumn("batch", number), "owners", partition_by="batch")
    family, found = SuffixFamily(scratch), None
    for b in range(batches):
        new = family.append(entries.where(F.col("batch") == b).select("h", "doc_id"))
        found = new if found is None else found.unionByName(new)
    family.close()
    places = scratch.write(entries.join(found.distinct(), "h", "left_semi").drop("batch"), "places")
    scratch.drop("owners")
    runs = scratch.write(first_places(docs, places, scratch, min_words), "runs")
    for name in ("contexts", "contexts-of-prefixes", "stretches"):
        scratch.drop(name)
    return memberships(places, runs, min_words)


def pairs(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, other_doc_id, other_start_word, n_words: every maximal match of two documents, the later one first, from the memberships.

    For classes small enough to be paired: it is quadratic in their size.
    """
    own = found.select("match_doc_id", F.col("match_start_word").alias("m0"), (F.col("match_start_word") + F.col("n_words")).alias("m1"), "doc_id", "start_word")
    x, y = (own.withColumnsRenamed({"m0": f"{s}0", "m1": f"{s}1", "doc_id": f"{s}_doc", "start_word": f"{s}_word"}) for s in "xy")
    both = x.join(y, "match_doc_id").where(f"x_doc > y_doc and least(x1, y1) - greatest(x0, y0) >= {min_words}")
    lo = F.greatest("x0", "y0")
    both = both.select(F.col("x_doc").alias("doc_id"), (F.col("x_word") + lo - F.col("x0")).alias("a"), F.col("y_doc").alias("m_doc"), (F.col("y_word") + lo - F.col("y0")).alias("m"), (F.least("x1", "y1") - lo).alias("len"))
    swap = F.col("doc_id") < F.col("match_doc_id")
    direct = found.select(
        F.greatest("doc_id", "match_doc_id").alias("doc_id"), F.when(swap, F.col("match_start_word")).otherwise(F.col("start_word")).alias("a"),
        F.least("doc_id", "match_doc_id").alias("m_doc"), F.when(swap, F.col("start_word")).otherwise(F.col("match_start_word")).alias("m"), F.col("n_words").alias("len"),
    )
    every = both.unionByName(direct).withColumn("shift", F.col("a") - F.col("m")).withColumn("b", F.col("a") + F.col("len"))
    order = Window.partitionBy("doc_id", "m_doc", "shift").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("chain", F.sum(F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).over(order))
    c = every.groupBy("doc_id", "m_doc", "shift", "chain").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return c.select("doc_id", F.col("a").alias("start_word"), F.col("m_doc").alias("other_doc_id"), (F.col("a") - F.col("shift")).alias("other_start_word"), (F.col("b") - F.col("a")).alias("n_words"))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return long_matches(read(spark, sf_dir, "documents"))
