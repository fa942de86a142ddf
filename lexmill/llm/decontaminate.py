"""Benchmark decontamination by latent semantic retrieval.

1. Words become 32-bit fingerprints, written once as compact binary columns; what follows reads these and not the texts. A
   fingerprint's lowest bits are its term.
2. Document frequencies over all documents give each term its weight, log(1 + N / df). Terms of more than COMMON of all documents (and more
   than COMMON_LEAST) tell languages and styles apart and not passages, and weigh nothing here; the checks below count them.
3. Randomised SVD of the matrix A of TF-IDF passages (PASSAGE words each, of all documents): with a fixed sparse test matrix W (a
   random column and sign for each term), each task sums its share of A'(A W), which is TERMS x SKETCH numbers however much text there
   is; the shares are added by blocks of terms. The orthonormal basis Q of the sum and the small matrix Q'A'AQ, recovered from Q'(A'AW) and Q'W, give the right
   singular vectors; the RANK leading ones, each divided by its singular value, are the latent space.
4. Each window of each document meets each benchmark item in that space, in matrix products. A window is STRETCH times as long as the item and begins at every
   BLOCK words, for items of LONG words and more at every second BLOCK, so that an item with as many words put in between fits wherever it
   begins. Pairs with a cosine of at least MIN_COSINE are candidates; so are windows that hold nearly all (VERBATIM) of the item's
   rarer words, whatever their cosine, as the space has little to say of an item whose words are in no other passage. Of items with fewer weighing words than
   LATENT_LEAST and LATENT_SHARE of all it says nothing: all windows are candidates that pass the bounds of step 5.
5. Candidates are checked by the longest common subsequence of words: at least MIN_LCS of the item's words, in order, in the window; and,
   where the benchmark has a column `answer`, at least MIN_ANSWER of the answer's words in order. Bounds come before:
   the window must hold as many of the item's rarer words, and then of all its words in any order, as the subsequence can't do without.

The weights, the basis and the items are sent to all tasks. The first two have a fixed size; a pass over the fingerprints takes PASS_ITEMS items,
which the tasks go through in blocks, so 1000 items are one pass and a task holds a block of items and a slice of text at a time.

Null and empty texts are never contaminated, nor is anything by an empty benchmark; items without a word are skipped. Very long texts are
searched in pieces that overlap by a window. Rows without doc_id are left out. Repeated rows give one
result each (doc_id, item_id), the best: of equal subsequences that of the greater cosine, then the later one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, buffers, words
from .shared import Scratch, id_and_text, pieces, read, slices, without

TERMS = 1 << 15
SKETCH, RANK = 40, 32
PASSAGE = 48
COMMON, COMMON_LEAST = 0.02, 16
BLOCK, LONG, STRETCH = 4, 20, 1.3
SHARES = (0.02, 0.05, 0.1, 0.2, 0.5, 2.0)  # of documents, below which a word may count as rarer; at last all words
MIN_COSINE = 0.3
VERBATIM = 0.8
LATENT_LEAST, LATENT_SHARE = 4, 0.2
MIN_LCS, MIN_ANSWER = 0.65, 0.5
ITEM_BLOCK = 64
PASS_ITEMS = 1 << 17
TERM_BLOCKS = 64
SEGMENT_WORDS = 1 << 17
PART = 512  # blocks or windows whose vectors stay in the processor's cache


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, words (4 bytes each)."""

    def column(parts: list[np.ndarray], ends: np.ndarray) -> pa.Array:
        h = parts[0] if len(parts) == 1 else np.concatenate(parts)
        wide = ends[-1] >= 1 << 31
        return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends if wide else ends.astype(np.int32)), pa.py_buffer(h)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_id, parts = None, []

        def finished() -> Iterator[pa.RecordBatch]:
            if parts:
                yield pa.RecordBatch.from_arrays([long_id, column(parts, np.array([0, 4 * sum(map(len, parts))]))], ["doc_id", "words"])

        for ids, base, data, offsets in pieces(it, 0):
            _, _, row, h = words(data, offsets)
            h = (h >> U64(32)).astype(np.uint32)
            if not base:
                yield from finished()
                parts = []
            if len(ids) == 1:
                long_id, parts = ids, [*parts, h]
            else:
                yield pa.RecordBatch.from_arrays([ids, column([h], np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int64) * 4)], ["doc_id", "words"])
        yield from finished()

    return id_and_text(docs, lower=True).select("doc_id", "text").mapInArrow(run, "doc_id long, words binary")


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    return np.frombuffer(data.tobytes(), dtype=np.uint32), offsets // 4


def _few_parts(df: DataFrame) -> DataFrame:
    """So many partitions as keep all cores busy: each of them makes one partial sum of a fixed size."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _summed(df: DataFrame, partial, width: int, dtype: str) -> np.ndarray:
    """The sum over partitions of a (TERMS, width) matrix: partial(batches) gives a partition's. Blocks of terms are added by a shuffle."""
    rows = TERMS // TERM_BLOCKS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(it)
        if total is not None:
            parts = [total[i * rows : (i + 1) * rows].astype(dtype).tobytes() for i in range(TERM_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(TERM_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(rows * width)
        for part in table.column(1):
            total += np.frombuffer(part.as_buffer(), dtype=dtype)
        return pa.table({"block": table.column(0)[:1], "part": pa.array([total.tobytes()], pa.binary())})

    found = df.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect()
    out = np.zeros((TERMS, width))
    for r in found:
        out[r.block * rows : (r.block + 1) * rows] = np.frombuffer(r.part).reshape(rows, width)
    return out


def term_frequencies(table: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents."""

    def partial(it: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, n = np.zeros((TERMS, 1)), 0
        for batch in slices(it, "words"):
            h, offsets = _tokens(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(offsets))
            keys = np.sort(row * U64(TERMS) + (h & np.uint32(TERMS - 1)))
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
            total[:, 0] += np.bincount((keys % U64(TERMS)).astype(np.int64), minlength=TERMS)
            n += batch.num_rows
        return total if n else None

    return _summed(_few_parts(table), partial, 1, "<f8")[:, 0], table.count()


def latent_weights(df: np.ndarray, n: int, common: float = COMMON) -> np.ndarray:
    """log(1 + N / df), and 0 for terms that are common or nowhere."""
    return np.where((df == 0) | ((df > common * n) & (df > COMMON_LEAST)), 0, np.log1p(n / np.maximum(df, 1))).astype(np.float32)


def latent_basis(table: DataFrame, weights: np.ndarray, sketch: int = SKETCH, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (TERMS x rank) of the weighted passage matrix and its singular values."""
    rng = np.random.default_rng(7)
    column, sign = rng.integers(0, sketch, TERMS), rng.choice([-1.0, 1.0], TERMS)
    shared = table.sparkSession.sparkContext.broadcast((weights, column.astype(np.int32), (sign * weights).astype(np.float32)))

    def partial(it: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        weights, column, value = shared.value
        total = None
        for batch in slices(it, "words", 2 << 20):
            h, offsets = _tokens(batch.column(1))
            if not len(h):
                continue
            term = (h & np.uint32(TERMS - 1)).astype(np.int64)
            at = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
            passage = np.cumsum(at % PASSAGE == 0) - 1
            n = int(passage[-1]) + 1
            some = weights[term] > 0
            term, passage = term[some], passage[some]
            z = np.bincount(column[term] * n + passage, weights=value[term], minlength=n * sketch).reshape(sketch, n)
            total = np.zeros((sketch, TERMS)) if total is None else total
            for i in range(sketch):
                total[i] += np.bincount(term, weights=z[i][passage], minlength=TERMS)
        if total is None:
            return None
        total = (total * weights).T
        return total

    y = _summed(_few_parts(table), partial, sketch, "<f4")
    if not y.any():
        return np.zeros((TERMS, rank), dtype=np.float32), np.zeros(rank)
    q, _ = np.linalg.qr(y)
    test = np.zeros((TERMS, sketch))
    test[np.arange(TERMS), column] = sign
    small = (q.T @ y) @ np.linalg.pinv(q.T @ test, rcond=1e-6)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return (q @ vectors[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0))


def places(item: np.ndarray) -> tuple[dict[int, int], int]:
    """For each word of the item the bits of its places, and how many words there are."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out, len(item)


def lcs(item: tuple[dict[int, int], int], window: list[int]) -> int:
    """Length of the longest common subsequence, by words of bits."""
    at, n = item
    full = v = (1 << n) - 1
    for w in window:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, answer (fingerprints) of the items that have a word."""
    answer = F.coalesce(F.col("answer").cast("string"), F.lit("")) if "answer" in benchmark.columns else F.lit("")
    b = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    both = fingerprints(b).withColumnRenamed("words", "item")
    if "answer" not in benchmark.columns:
        return both.select(F.col("doc_id").alias("item_id"), "item", F.lit(b"").alias("answer")).where("octet_length(item) > 0").distinct()
    answers = fingerprints(b.select("doc_id", F.col("answer").alias("text"))).withColumnRenamed("words", "answer")
    return both.join(answers, "doc_id").select(F.col("doc_id").alias("item_id"), "item", "answer").where("octet_length(item) > 0").distinct()


def window_size(length: int) -> tuple[int, int]:
    """Blocks of a window for an item of so many words, and of the step between windows."""
    step = 1 if length < LONG else 2
    return -(-int(np.ceil(STRETCH * length)) // BLOCK) + step, step


def prepared(items: list, df: np.ndarray, n_docs: int, space: np.ndarray, min_lcs: float) -> list[dict]:
    """What the tasks need of each block of items."""
    share = df / max(1, n_docs)
    out = []
    for begin in range(0, len(items), ITEM_BLOCK):
        part = items[begin : begin + ITEM_BLOCK]
        tokens = [np.frombuffer(r.item, np.uint32) for r in part]
        vectors = np.stack([space[t & (TERMS - 1)].sum(0) for t in tokens])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        sizes = [window_size(len(t)) for t in tokens]
        least, nearly, terms, of_item = [], [], [], []
        for j, t in enumerate(tokens):
            best = None
            for limit in SHARES:
                rare = share[t & (TERMS - 1)] < limit
                needed = int(np.ceil(len(t) * min_lcs - 1e-9)) - int((~rare).sum())
                own = np.unique(t[rare] & np.uint32(TERMS - 1))
                worth = needed / (1 + sizes[j][0] * BLOCK * min(1.0, float(share[own].sum()) / 50))
                if best is None or worth > best[0]:
                    best = (worth, needed, own, int(rare.sum()))
            least.append(max(1, best[1]))
            weighing = int((space[t & (TERMS - 1)] != 0).any(axis=1).sum())
            silent = weighing < max(LATENT_LEAST, LATENT_SHARE * len(t))
            nearly.append(least[-1] if silent else max(least[-1], int(np.ceil(VERBATIM * best[3]))))
            terms.append(best[2])
            of_item.append(np.full(len(best[2]), j))
        order = np.argsort(np.concatenate(terms), kind="stable")
        out.append({
            "ids": [r.item_id for r in part], "tokens": tokens, "answers": [np.frombuffer(r.answer, np.uint32) for r in part], "vectors": vectors.astype(np.float32), "sizes": sizes,
            "least": np.array(least), "nearly": np.array(nearly), "terms": np.concatenate(terms)[order].astype(np.int64), "of_item": np.concatenate(of_item)[order],
        })
    return out


class Segment:
    """Some words of a slice of documents, cut into blocks, with the running sums of their latent vectors."""

    def __init__(self, h: np.ndarray, offsets: np.ndarray, space: np.ndarray):
        self.h, self.offsets = h, offsets
        self.term = (h & np.uint32(TERMS - 1)).astype(np.int64)
        at = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
        starts = at % BLOCK == 0
        self.block = np.cumsum(starts) - 1
        self.begins = np.flatnonzero(starts)
        self.n = len(self.begins)
        self.row = np.searchsorted(offsets, self.begins, side="right") - 1
        self.first, self.last = np.searchsorted(self.row, self.row), np.searchsorted(self.row, self.row, side="right")
        terms = np.full((self.n, BLOCK), len(space))  # of each block; the row after the last of the space is zero
        terms[self.block, at % BLOCK] = self.term
        space = np.concatenate((space, np.zeros((1, space.shape[1]), space.dtype)))
        self.sums = np.zeros((self.n + 1, space.shape[1]))
        for a in range(0, self.n, PART):
            part = terms[a : a + PART]
            total = space[part[:, 0]]
            for i in range(1, BLOCK):
                total += space[part[:, i]]
            self.sums[a + 1 : a + 1 + len(part)] = total
        np.cumsum(self.sums, axis=0, out=self.sums)
        self.parts = np.empty((2, PART, space.shape[1]))
        self.starts: dict[int, tuple] = {}
        self.windows: dict[tuple[int, int], tuple] = {}

    def of_size(self, size: tuple[int, int]) -> tuple:
        """First and last block (exclusive) of all windows of a size, and their latent vectors and these' lengths."""
        found = self.windows.get(size)
        if found is None:
            span, step = size
            if step not in self.starts:
                b = np.arange(self.n)
                b = b[(b - self.first) % step == 0]
                self.starts[step] = b, self.first[b] == b, self.last[b]
            w, is_first, last = self.starts[step]
            stop = np.minimum(w + span, last)
            some = (stop - w > span - step) | is_first
            w, stop = w[some], stop[some]
            x = np.empty((len(w), self.sums.shape[1]), dtype=np.float32)
            square = np.empty(len(w), dtype=np.float32)
            for a in range(0, len(w), PART):
                part = slice(a, a + PART)
                upper, lower = (p[: len(w[part])] for p in self.parts)
                np.take(self.sums, stop[part], axis=0, out=upper, mode="clip")
                np.take(self.sums, w[part], axis=0, out=lower, mode="clip")
                x[part] = np.subtract(upper, lower, out=upper)
                np.einsum("ij,ij->i", x[part], x[part], out=square[part])
            found = (w, stop, x, np.maximum(np.sqrt(square), 1e-9))
            self.windows = {size: found}  # one at a time; items come in the order of their sizes
        return found


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times the transpose of y, in products so small that no threads are set up for them: they would only wait for each other in a busy worker."""
    rows = max(1, (1 << 18) // y.size)
    whole = len(x) // rows * rows
    out = np.empty((len(x), len(y)), dtype=x.dtype)
    out[:whole] = np.matmul(x[:whole].reshape(-1, rows, x.shape[1]), y.T).reshape(whole, len(y))
    out[whole:] = x[whole:] @ y.T
    return out


def candidates(seg: Segment, block: dict, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last block, number of the item, cosine."""
    m = len(block["tokens"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(block["terms"], minlength=TERMS))))
    many = np.diff(ends)[seg.term]
    hit = np.flatnonzero(many)
    many = many[hit]
    where = np.repeat(ends[seg.term[hit]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    item, at = block["of_item"][where], np.repeat(seg.block[hit], many)
    at = at[np.argsort(item.astype(np.uint16), kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(item, minlength=m))))
    upto = np.zeros(seg.n + 1, dtype=np.int32)  # rarer words of one item before each block
    for size in sorted(set(block["sizes"])):
        own = np.array([j for j, s in enumerate(block["sizes"]) if s == size])
        w, stop, x, length = seg.of_size(size)
        cos = product(x, block["vectors"][own])
        near = cos >= (min_cosine * length)[:, None]
        for k, j in enumerate(own):
            least, hits = block["least"][j], at[begin[j] : begin[j + 1]]
            if not (hits[least - 1 :] - hits[: max(0, len(hits) - least + 1)] < size[0]).any():
                continue  # nowhere are so many as close together as in a window
            np.cumsum(np.bincount(hits, minlength=seg.n), out=upto[1:])
            held = upto[stop] - upto[w]
            passed = np.flatnonzero(held >= least)
            passed = passed[near[passed, k] | (held[passed] >= block["nearly"][j])]
            if len(passed):
                yield w[passed], stop[passed], np.full(len(passed), j), cos[passed, k] / length[passed]


def checked(seg: Segment, block: dict, found: tuple, min_lcs: float, min_answer: float) -> Iterator[tuple]:
    """row, number of the item, words in common, cosine, share of the answer (None without one), first word of the candidates that pass."""
    tokens, answers = block["tokens"], block["answers"]
    terms = np.unique(np.concatenate([t & np.uint32(TERMS - 1) for t in tokens]))
    known = np.zeros(TERMS, dtype=np.int32)  # a number for each term of the items, 0 for others
    known[terms] = np.arange(1, len(terms) + 1)
    member = np.zeros((len(terms) + 1, len(tokens)), dtype=bool)
    for j, t in enumerate(tokens):
        member[known[t & np.uint32(TERMS - 1)], j] = True
    item_places, answer_places = {}, {}
    need_of = np.ceil(np.array([len(t) for t in tokens]) * min_lcs - 1e-9)
    for begin in range(0, len(found[0]), 1 << 16):
        w, stop, j, cos = (x[begin : begin + (1 << 16)] for x in found)
        b0 = seg.begins[w]
        size = np.append(seg.begins, len(seg.h))[stop] - b0
        need = need_of[j]
        shared = np.zeros(len(w), dtype=np.int32)
        for k in range(int(size.max())):  # words of the window that the item has: no less than the subsequence
            ok = k < size
            shared += member[known[seg.term[np.where(ok, b0 + k, b0)]], j] & ok
        row = seg.row[w]
        at = np.flatnonzero(shared >= need)
        at = at[np.lexsort((-cos[at], -shared[at], j[at], row[at]))]  # of a document and item, those that may have the most come first
        key, most = None, (0, 0.0)
        for c in at:
            if (row[c], j[c]) != key:
                key, most = (row[c], j[c]), (0, 0.0)
            if (shared[c], cos[c]) <= most:
                continue  # no better than what was found
            item = int(j[c])
            if item not in item_places:
                item_places[item], answer_places[item] = places(tokens[item]), places(answers[item])
            span = slice(b0[c], b0[c] + size[c])
            common = lcs(item_places[item], seg.h[span][member[known[seg.term[span]], item]].tolist())
            if common < need[c]:
                continue
            part = lcs(answer_places[item], seg.h[span].tolist()) / len(answers[item]) if len(answers[item]) else None
            if part is None or part >= min_answer:
                most = max(most, (common, float(cos[c])))
                yield int(row[c]), item, common, float(cos[c]), part, int(b0[c] - seg.offsets[row[c]])


RESULT = "doc_id long, item_id long, cosine double, lcs int, coverage double, answer_coverage double, start_word int"


def search(table: DataFrame, blocks: list[dict], space: np.ndarray, min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER) -> DataFrame:
    """doc_id, item_id, cosine, lcs, coverage, answer_coverage, start_word for the items of the blocks."""
    shared = table.sparkSession.sparkContext.broadcast((space, blocks))
    overlap = max((size[0] for b in blocks for size in b["sizes"]), default=0) * BLOCK
    step = max(SEGMENT_WORDS, 2 * overlap) // (2 * BLOCK) * 2 * BLOCK

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(it, "words", 4 * SEGMENT_WORDS):
            h, offsets = _tokens(batch.column(1))
            for a in range(0, max(1, len(h)), step) if batch.num_rows == 1 else [0]:
                part = h[a : a + step + overlap] if batch.num_rows == 1 else h
                if len(part):
                    yield batch.column(0), a, part, np.array([0, len(part)]) if batch.num_rows == 1 else offsets

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, blocks = shared.value
        for ids, base, h, offsets in segments(it):
            seg = Segment(h, offsets, space)
            best: dict[tuple[int, int], tuple] = {}
            for b, block in enumerate(blocks):
                found = list(candidates(seg, block, min_cosine))
                if found:
                    for row, item, *entry in checked(seg, block, tuple(map(np.concatenate, zip(*found))), min_lcs, min_answer):
                        key = (row, b * ITEM_BLOCK + item)
                        if key not in best or entry[:2] > best[key][:2]:
                            best[key] = entry
            if best:
                size = [len(blocks[i // ITEM_BLOCK]["tokens"][i % ITEM_BLOCK]) for _, i in best]
                common, cos, part, start = zip(*best.values())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r for r, _ in best])), pa.array([int(blocks[i // ITEM_BLOCK]["ids"][i % ITEM_BLOCK]) for _, i in best]), pa.array(cos), pa.array(common, pa.int32()), pa.array([c / n for c, n in zip(common, size)]), pa.array(part, pa.float64()), pa.array([base + x for x in start], pa.int32())],
                    ["doc_id", "item_id", "cosine", "lcs", "coverage", "answer_coverage", "start_word"],
                )

    return table.mapInArrow(run, RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_lcs: float = MIN_LCS, **limits: float) -> DataFrame:
    """doc_id, item_id, cosine, lcs, coverage, answer_coverage, start_word of the documents that hold an item or a paraphrase of it."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    table = scratch.write(fingerprints(docs), "words")
    order = Window.orderBy(F.octet_length("item"), "item_id", "item", "answer")  # a benchmark is small against a corpus
    items = scratch.write(benchmark_items(benchmark).withColumn("n", F.row_number().over(order) - 1), "items")
    n = items.count()
    found = docs.sparkSession.createDataFrame([], RESULT)
    if not n:
        return found
    df, n_docs = term_frequencies(table)
    weights = latent_weights(df, n_docs)
    basis, values = latent_basis(table, weights)
    space = (basis * weights[:, None] / np.maximum(values, 1e-6 * max(1e-9, values[0]))).astype(np.float32)
    for begin in range(0, n, PASS_ITEMS):
        part = items.where((F.col("n") >= begin) & (F.col("n") < begin + PASS_ITEMS)).orderBy("n").collect()
        found = found.unionByName(search(table, prepared(part, df, n_docs, space, min_lcs), space, min_lcs=min_lcs, **limits))
    found = found.withColumn("cosine", F.round("cosine", 5))  # sums of single precision depend on the size of the block
    one = F.max_by(F.struct("cosine", "lcs", "coverage", "answer_coverage", "start_word"), F.struct("lcs", "cosine", "start_word"))
    return found.groupBy("doc_id", "item_id").agg(one.alias("x")).select("doc_id", "item_id", "x.*")


def apply(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; rows without doc_id stay."""
    return without(docs, contaminated(docs, benchmark).select("doc_id").distinct())


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
