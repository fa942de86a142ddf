"""Substring dedup by sliding sentence spans.

From each sentence on, the run of RUN consecutive sentences, and of as many more as make up MIN_WORDS words, is hashed, and likewise one
backwards from the end of each text, so that a copy is covered to its last sentence; equal runs are joined over the whole table, and in each document the sentences covered by a run that is not the first of its kind, by (doc_id,
hash of the text, sentence), are removed. A sentence ends
with its line or after . ! or ? that no letter or digit follows; parts without a word are no sentences and always stay.

The firsts are found by an aggregation that combines in the map tasks, so that a run that is everywhere does not gather in one
task; only hashes that repeat are joined back, and only documents that lose a sentence are returned. Null and empty texts and texts without
a whole run lose nothing; an empty table gives an empty one; very long texts are cut whole, as one row of Arrow. Rows without doc_id are left out, and so are columns but
doc_id and text. Repeated rows with the same doc_id and text are one document and cut alike; different texts under one doc_id are different documents. Case and punctuation inside a run: words are compared as they are
written, what stands between them is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import buffers, sentences, signed, word_spans
from .shared import Scratch, id_and_text, read, slices

RUN = 2
MIN_WORDS = 15
TAIL = 1 << 30  # added to the first sentence of a run that is taken from the end of its text


def run_ends(row: np.ndarray, w0: np.ndarray, w1: np.ndarray, run_length: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The last sentence of the run from each sentence on, and whether the run is whole in its row."""
    n = len(row)
    last = np.maximum(np.arange(n) + run_length - 1, np.searchsorted(w1, w0 + min_words))
    inside = np.minimum(last, n - 1)
    return inside, (last < n) & (row[inside] == row)


def tails(first: np.ndarray, w0: np.ndarray, w1: np.ndarray, last: np.ndarray, run_length: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest whole run at the end of each row, where no run from its first sentence on is the same."""
    begin, end = first[:-1], first[1:]
    rows = np.flatnonzero(end - begin >= run_length)
    stop = end[rows] - 1
    start = np.minimum(stop - run_length + 1, np.searchsorted(w0, w1[stop] - min_words, side="right") - 1)
    ok = start >= begin[rows]
    start, stop = start[ok], stop[ok]
    own = last[start] != stop
    return start[own], stop[own]


def runs_of_sentences(docs: DataFrame, run_length: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """h, doc_id, v (a hash that tells texts of one doc_id apart), s (number of the run's first sentence)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            data, offsets = buffers(batch.column(2))
            starts, _, row, w0, w1, sums = sentences(data, offsets)
            if not len(starts):
                continue
            last, whole = run_ends(row, w0, w1, run_length, min_words)
            at = np.flatnonzero(whole)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            begin, end = tails(first, w0, w1, last, run_length, min_words)
            h = word_spans(sums, w0[np.append(at, begin)], w1[np.append(last[at], end)])
            at, mark = np.append(at, begin), np.repeat([0, TAIL], [len(at), len(begin)])
            r = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array((at - first[r] + mark).astype(np.int32))], ["h", "doc_id", "v", "s"])

    return id_and_text(docs).select("doc_id", F.hash("text").alias("v"), "text").mapInArrow(run, "h long, doc_id long, v int, s int")


def repeats(docs: DataFrame, run_length: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, v, runs (first sentences of its runs that have come before), first_doc_ids (where they came first)."""
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    spans = scratch.write(runs_of_sentences(docs, run_length, min_words), "spans")
    firsts = spans.groupBy("h").agg(F.min(F.struct("doc_id", "v", "s")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h", F.col("f.doc_id").alias("f_doc"), F.col("f.v").alias("f_v"), F.col("f.s").alias("f_s"))
    later = spans.join(firsts, "h").where("doc_id != f_doc or v != f_v or s != f_s")
    return later.groupBy("doc_id", "v").agg(F.sort_array(F.collect_set("s")).alias("runs"), F.sort_array(F.collect_set("f_doc")).alias("first_doc_ids"))


def cut(docs: DataFrame, found: DataFrame, run_length: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_sentences, n_removed, first_doc_ids of the documents in `found`; text is what stays of it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            data, offsets = buffers(batch.column(1))
            starts, ends, row, w0, w1, _ = sentences(data, offsets)
            last, _ = run_ends(row, w0, w1, run_length, min_words) if len(row) else (row, row)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            texts, total, removed = [], [], []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                n = first[i + 1] - first[i]
                at = np.asarray([r for r in runs if r < n], dtype=np.int64)
                gone = np.zeros(n + 1, dtype=np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, np.minimum(last[first[i] + at] - first[i] + 1, n), -1)
                for r in runs:
                    if TAIL <= r < TAIL + n:
                        gone[r - TAIL] += 1
                gone = np.cumsum(gone[:n]) > 0
                keep = np.ones(offsets[i + 1] - offsets[i], dtype=bool)
                for a, b in zip(starts[first[i] : first[i + 1]][gone] - offsets[i], ends[first[i] : first[i + 1]][gone] - offsets[i]):
                    keep[a:b] = False
                texts.append(data[offsets[i] : offsets[i + 1]][keep].tobytes().decode())
                total.append(len(gone))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(removed, pa.int32()), batch.column(3)], ["doc_id", "text", "n_sentences", "n_removed", "first_doc_ids"])

    both = id_and_text(docs).withColumn("v", F.hash("text")).join(found, ["doc_id", "v"]).select("doc_id", "text", "runs", "first_doc_ids")
    return both.mapInArrow(run, "doc_id long, text string, n_sentences int, n_removed int, first_doc_ids array<long>")


def remove_repeats(docs: DataFrame, run_length: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    return cut(docs, repeats(docs, run_length, min_words), run_length, min_words)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
