"""Compression classifier: two zstandard dictionaries, of good and of bad labelled texts, and the sizes they compress a text to.

A text is cut into blocks of BLOCK bytes, all of which are compressed on their own with either dictionary, so that long texts
are judged by all of their parts and not by what the dictionary does for their beginning. The statistic is
(size with bad dictionary - size with good dictionary) / bytes; a logistic curve fitted on held-out labelled rows, weighted
by the classes' shares of all labels, turns it into `score`, the probability of good quality.

Dictionaries and curve are fitted on at most `max_rows` labelled documents of each class and half of `max_bytes` of their text, those with the
least hash of doc_id. Of a labelled text longer than `max_text` bytes, blocks evenly spread over all of it stand for it, `max_text` bytes together, so that no
long text keeps others out. Two thirds train the dictionaries, the rest the curve. Contradicting and null labels are left out; of several texts under one doc_id the least stands.
Null and empty texts have statistic 0 and get the curve's value there. With labelled texts of one class only (or none) score is
null and everything is kept. Each input row gives one output row, also repeated ones and those without doc_id; an empty table gives none; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decision_list import clean_labels, sample
from .shared import read, slices

MAX_ROWS = 1000
MAX_BYTES = 48 << 20
MAX_TEXT = 1 << 20
DICT_BYTES = 64 << 10
BLOCK = 2048
LEVEL = 3


def train(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; of few samples, for which training fails, their plain content."""
    import zstandard as zstd

    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstd.train_dictionary(size, parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[:size]


def compressors(good: bytes, bad: bytes) -> list:
    import zstandard as zstd

    out = []
    for raw in (good, bad):
        d = zstd.ZstdCompressionDict(raw) if raw[:4] == b"\x37\xa4\x30\xec" else zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def statistic(pair: list, text: bytes) -> float:
    if not text:
        return 0.0
    good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in pair)
    return (bad - good) / len(text)


def calibrate(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Scale, slope and intercept of a logistic curve, by Newton steps; the targets are Platt's, off 0 and 1 by the counts."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    y = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(x.std()) or 1.0
    a = np.stack((x / scale, np.ones(len(x))), 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weights * (y - p)) - ridge * w
        hess = (a * (weights * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if abs(step).max() < 1e-9:
            break
    return scale, float(w[0]), float(w[1])


def spread(text: bytes, size: int) -> bytes:
    """Blocks evenly spread over the text, of `size` bytes together; a shorter text as it is."""
    if len(text) <= size:
        return text
    n, last = max(1, size // BLOCK), len(text) - BLOCK
    return b"".join(text[a : a + BLOCK] for a in (last * i // max(1, n - 1) for i in range(n)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_text: int = MAX_TEXT) -> dict | None:
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pa.array([spread(t.as_buffer().to_pybytes(), max_text) for t in batch.column(2).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["doc_id", "quality", "text"])

    rows = sample(docs, labels, max_rows).where("text is not null and text != ''").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(shorten, "doc_id long, quality int, text binary")
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")  # at most max_rows rows
    rows = rows.withColumn("__sum", F.sum(F.octet_length("text")).over(order)).where(F.col("__sum") <= max(max_bytes // 2, max_text)).select("doc_id", "quality", "text").toPandas()
    if rows["quality"].nunique() < 2:
        return None
    rows = rows.sort_values(["quality", "doc_id"], kind="stable")
    texts = [bytes(t) for t in rows["text"]]
    y = rows["quality"].to_numpy().astype(float)
    held = np.zeros(len(y), dtype=bool)
    for q in (0, 1):
        held[np.flatnonzero(y == q)[2::3]] = True
    dicts = [train([t for t, h, k in zip(texts, held, y) if not h and k == q]) for q in (1, 0)]
    pair = compressors(*dicts)
    use = held if len(set(y[held])) == 2 else np.ones(len(y), dtype=bool)
    x = np.array([statistic(pair, t) for t, u in zip(texts, use) if u])
    shares = {r.quality: r["count"] for r in clean_labels(labels).groupBy("quality").count().collect()}
    total = sum(shares.values())
    yy = y[use]
    weights = np.where(yy == 1, shares.get(1, 1) / total / max(1, (yy == 1).sum()), shares.get(0, 1) / total / max(1, (yy == 0).sum())) * len(yy)
    return {"good": dicts[0], "bad": dicts[1], "curve": calibrate(x, yy, weights)}


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, statistic, score, keep (score of at least a half)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pair = compressors(model["good"], model["bad"]) if model else None
        for batch in slices(batches, "text"):
            if pair:
                x = np.array([statistic(pair, t) for t in batch.column(1).cast(pa.binary()).to_pylist()])
                scale, slope, intercept = model["curve"]
                score = 1 / (1 + np.exp(-np.clip(x / scale * slope + intercept, -30, 30)))
                columns = [pa.array(x), pa.array(score), pa.array(score >= 0.5)]
            else:
                n = batch.num_rows
                columns = [pa.array(np.zeros(n)), pa.nulls(n, pa.float64()), pa.array(np.ones(n, dtype=bool))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "statistic", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, statistic double, score double, keep boolean")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels")))
