"""Near-duplicate search with ProbMinHash signatures of weighted shingles, banding, and verification.

A document is the multiset of its runs of N words (in lower case; all of its words, if they are fewer), weighted by how often each
occurs. For each element a Poisson process with the rate of its weight hands out arrivals, each to another register, in the order of
an element's own permutation of the M registers; a register keeps the element that arrives first. An element stops once
its next arrival is later than the latest register of its document. Equal registers then estimate the probability Jaccard
similarity. All elements of all documents of a slice advance together, one arrival a round.

Documents with equal bands of R registers are candidates. Each candidate pair is verified on the whole texts with the exact probability
Jaccard similarity. Documents joined by verified pairs, also through others, are a group. Each document is first compared with the
least doc_id of its bucket and with the one before it, which joins most groups; then all other pairs of a bucket whose documents are
not in one group yet are. So each pair of a bucket is in one group or was rejected, whatever else fills the bucket. A bucket's least document comes of
an aggregation that combines in the map tasks, and large buckets are ordered in parts, so none gathers in one task; copies of a text join one group with the first pairs. With 40 bands of 4, a pair at the threshold of 0.5 shares a band with probability 0.92, at 0.6 with 0.996.

Null and empty texts, and texts without a word, have no signature and no partner, nor has an empty table any. Very long texts are cut into shingles
and given registers piece by piece. Rows without doc_id are left out. Rows that share a
doc_id are no pair; both carry what the id gets. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import CUT_BYTES, U64, buffers, cuts, mix, signed, word_spans, word_sums, words
from .shared import Scratch, id_and_text, read, slices, without

N = 3
M = 163  # a prime, so that r = a * i + b is a permutation of the registers
BANDS, R = 40, 4
THRESHOLD = 0.5
PART = 1000  # about as many members of a bucket are ordered in one task
AT_ONCE = 1 << 20  # elements


def elements(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of the rows: row, 44-bit hash (ascending in a row), count."""
    if len(offsets) == 2 and len(data) > CUT_BYTES:
        keys = np.sort(np.concatenate([_keys(data[a:b], np.array([0, b - a]), n) for a, b, _ in cuts(data, n - 1)]))
    else:
        keys = np.sort(_keys(data, offsets, n))
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> U64(44)).astype(np.int64), keys & U64((1 << 44) - 1), counts


def _keys(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Row (20 bits) and hash (44 bits) of all shingles."""
    _, _, row, h = words(data, offsets)
    if not len(h):
        return np.zeros(0, np.uint64)
    sums = word_sums(h)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    last = np.append(first[1:], len(h))
    starts = np.arange(len(h))
    ends = np.minimum(starts + n, last[row])
    take = (ends - starts == n) | ((starts == first[row]) & (last[row] - first[row] < n))
    starts, ends = starts[take], ends[take]
    return (row[starts].astype(np.uint64) << U64(44)) | (word_spans(sums, starts, ends) >> U64(20))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int = M) -> tuple[np.ndarray, np.ndarray]:
    """The m registers of each row (hashes of the elements that came first), and whether the row has any element."""
    times = np.full(rows * m, np.inf)
    winner = np.zeros(rows * m, dtype=np.uint64)
    for begin in range(0, len(row), AT_ONCE):
        part = slice(begin, begin + AT_ONCE)
        _arrive(times, winner, row[part], element[part], weight[part], rows, m)
    has = np.zeros(rows, dtype=bool)
    has[row] = True
    return winner.reshape(rows, m), has


def _arrive(times: np.ndarray, winner: np.ndarray, row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> None:
    seed = mix(element + U64(0x51ED270B9F3C4D27))
    step = (mix(seed) % U64(m - 1)).astype(np.int64) + 1
    register = (mix(seed ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(m)).astype(np.int64)
    clock = np.zeros(len(row))
    live_row, live_seed, live_weight = row, seed, weight.astype(float)
    base = row * m
    for i in range(m):
        u = (mix(live_seed + U64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        clock = clock - np.log(u) / (live_weight * (1 - i / m))
        at = base + register
        np.minimum.at(times, at, clock)
        won = times[at] == clock
        winner[at[won]] = live_seed[won]
        latest = times.reshape(rows, m).max(1)
        live = clock < latest[live_row]
        if not live.any():
            break
        live_row, live_seed, live_weight, clock, base = live_row[live], live_seed[live], live_weight[live], clock[live], base[live]
        step, register = step[live], register[live]
        register = (register + step) % m


def similarity(ka: np.ndarray, ca: np.ndarray, kb: np.ndarray, cb: np.ndarray) -> float:
    """The probability Jaccard similarity of two multisets (ascending keys, counts): the sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    common = kb[at] == ka
    a, b = ca[common].astype(float), cb[at[common]].astype(float)
    if not len(a):
        return 0.0
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    upto = np.searchsorted(ratio, ratio, side="right")  # ties take the a side, where both are equal
    sum_a = np.concatenate(([0], np.cumsum(a)))
    sum_b = np.concatenate(([0], np.cumsum(b)))
    only_a, only_b = ca.sum() - a.sum(), cb.sum() - b.sum()
    return float((1 / ((only_a + sum_a[upto]) / a + (only_b + sum_b[-1] - sum_b[upto]) / b)).sum())


def bands(docs: DataFrame, n: int = N, m: int = M, count: int = BANDS, r: int = R) -> DataFrame:
    """band, doc_id: a row for each band of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column(1))
            row, element, weight = elements(data, offsets, n)
            sig, has = signatures(row, element, weight, batch.num_rows, m)
            parts = sig[has, : count * r].reshape(-1, count, r)
            h = np.broadcast_to(mix(np.arange(1, count + 1, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F)), parts.shape[:2]).copy()
            for j in range(r):
                h = mix(h * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
            ids = batch.column(0).to_numpy()[has]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h.reshape(-1))), pa.array(np.repeat(ids, count))], ["band", "doc_id"])

    return id_and_text(docs, lower=True).select("doc_id", "text").mapInArrow(run, "band long, doc_id long")


def buckets(b: DataFrame) -> DataFrame:
    """band, doc_id, least, part: the bands that more than one document has, with the least of them; part cuts large buckets into parts of about PART rows."""
    of = b.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size")).where("least != most")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / PART))
    return b.join(of, "band").select("band", "doc_id", "least", part.cast("int").alias("part"))


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs a > b of a bucket: each document with the least one and, in its part of the bucket, with the least one and the one before it."""
    order = Window.partitionBy("band", "part").orderBy("doc_id")
    b = members.select("doc_id", "least", F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lag("doc_id").over(order).alias("before"))
    pairs = b.where("doc_id > least").select(F.col("doc_id").alias("a"), F.explode(F.array("least", "first", "before")).alias("b")).where("a > b")
    return pairs.distinct()


def remaining(members: DataFrame, group: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct pairs a > b of a bucket that are in different groups and not among those done."""
    m = members.select("band", "doc_id").distinct().join(group, "doc_id", "left").select("band", "doc_id", F.coalesce("group_id", "doc_id").alias("g"))
    mixed = m.groupBy("band").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least != most").select("band")
    m = m.join(mixed, "band", "left_semi")
    a, b = (m.select("band", F.col("doc_id").alias(n), F.col("g").alias(f"g{n}")) for n in "ab")
    pairs = a.join(b, "band").where("a > b and ga != gb").select("a", "b").distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def verified(docs: DataFrame, pairs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of the pairs whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta"), "tb"):
            sides = []
            for k in (2, 3):
                data, offsets = buffers(batch.column(k))
                row, element, weight = elements(data, offsets, n)
                sides.append((np.searchsorted(row, np.arange(batch.num_rows + 1)), element, weight))
            (ra, ka, ca), (rb, kb, cb) = sides
            sim = np.array([similarity(ka[ra[i] : ra[i + 1]], ca[ra[i] : ra[i + 1]], kb[rb[i] : rb[i + 1]], cb[rb[i] : rb[i + 1]]) for i in range(batch.num_rows)])
            ok = np.flatnonzero(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "similarity"])

    texts = id_and_text(docs, lower=True)
    left = texts.withColumnsRenamed({"doc_id": "a", "text": "ta"})
    right = texts.withColumnsRenamed({"doc_id": "b", "text": "tb"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long, similarity double")


def groups(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, group_id (the least doc_id of its connected component) of all nodes but the least ones.

    Alternating large-star and small-star steps; each round is written, which cuts the lineage, until the edges no longer change.
    """
    e = scratch.write(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v"), "edges-0")
    state, k = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        k += 1
        e = scratch.write(small, f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
        state = now


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, duplicate_of: a pair for each document of a group but its first; duplicate_of is the group's least doc_id."""
    scratch = Scratch(docs.sparkSession, "prob_minhash")
    members = scratch.write(buckets(scratch.write(bands(docs), "bands")), "buckets")
    scratch.drop("bands")
    pairs = scratch.write(candidates(members), "pairs")
    edges = scratch.write(verified(docs, pairs, threshold=threshold).select("a", "b"), "verified")
    group = groups(edges, scratch)
    rest = scratch.write(remaining(members, group, pairs), "remaining")
    scratch.drop("buckets")
    more = scratch.write(verified(docs, rest, threshold=threshold).select("a", "b"), "verified-remaining")
    scratch.drop("remaining")
    if not more.isEmpty():
        group = groups(group.select(F.col("doc_id").alias("a"), F.col("group_id").alias("b")).unionByName(more), Scratch(docs.sparkSession, "prob_minhash"))
    return group.select("doc_id", F.col("group_id").alias("duplicate_of"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents without those that duplicate one with a lesser doc_id; of each group one id stays."""
    return without(docs, duplicates(docs).select("doc_id"))


def op7_prob_minhash(spark, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "documents"))
