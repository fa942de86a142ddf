"""Byte-level BPE as a monoid: encode halves recursively and join neighbours; decode by concatenation up the tree.

Joining. The pre-tokenisation pattern has no piece that goes on from a visible character to white space, and no piece that
ends at such a place depends on what follows. Each place where white space follows a visible character is thus a
piece boundary in any context, and encode(a + b) = encode(a) + encode(b) there: tokens on its far side are stable. A join
grows a window left and right of the seam (doubling it) until both ends are at such places, encodes only the window
anew, and keeps all tokens outside. Without such a place the window grows to the whole of a side, which is exact as well.

Nulls and empty texts have no tokens. All rows stay, also repeated ones and those without doc_id; columns other than
doc_id and text are left out. Texts of any length are encoded whole; leaves bound what the encoder sees at once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 4096
_SEAM = re.compile(r"[^\s\x1c-\x1f᠎​-‏﻿](?=[ \n\r\t])")


class Codec:
    """An encoder and decoder over a file of ranks (base64 token and rank in each line), given as its bytes."""

    def __init__(self, ranks: bytes, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.leaf_chars = leaf_chars
        size = max(table.values()) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        ordered = sorted(table.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(token for token, _ in ordered), dtype=np.uint8)

    def leaf(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """encode(left + right) from a = encode(left) and b = encode(right)."""
        if not left or not right:
            return a if left else b
        window = 32
        while True:  # the last stable place of the left side; the seam itself may be one
            tail = left[-window - 1 :] + right[0]
            cuts = [m.end() for m in _SEAM.finditer(tail)]
            if cuts or window >= len(left):
                p = len(left) + 1 - len(tail) + cuts[-1] if cuts else 0
                break
            window *= 2
        if p == len(left):
            return np.concatenate((a, b))
        window = 32
        while True:  # the first stable place of the right side
            found = _SEAM.search(right, 0, window)
            if found or window >= len(right):
                q = found.end() if found else len(right)
                break
            window *= 2
        keep_a = self._tokens_of(a[::-1], len(left[p:].encode()))
        drop_b = self._tokens_of(b, len(right[:q].encode()))
        return np.concatenate((a[: len(a) - keep_a], self.leaf(left[p:] + right[:q]), b[drop_b:]))

    def _tokens_of(self, tokens: np.ndarray, size: int) -> int:
        """How many leading tokens make up exactly `size` bytes."""
        step = 64
        while True:
            sums = np.cumsum(self.lengths[tokens[:step]])
            if step >= len(tokens) or sums[-1] >= size:
                n = int(np.searchsorted(sums, size)) + 1 if size else 0
                assert n == 0 or sums[n - 1] == size, "the seam is not a token boundary"
                return n
            step *= 4

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, tokens: np.ndarray, leaf_tokens: int = 1 << 16) -> bytes:
        if len(tokens) > leaf_tokens:
            mid = len(tokens) // 2
            return self.decode(tokens[:mid], leaf_tokens) + self.decode(tokens[mid:], leaf_tokens)
        size = self.lengths[tokens]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[tokens] - (ends - size), size)
        return self.bytes[at].tobytes()


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(docs: DataFrame, ranks_path: str = RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, tokens, and round_trip: whether decoding gives the text again.

    The ranks are read on the driver and sent with the task, as their size is that of a vocabulary, whatever the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in slices(batches, "text"):
            codec = codec or Codec(ranks.value, leaf_chars)
            texts = batch.column(1).to_pylist()
            tokens = [codec.encode(t) for t in texts]
            same = [codec.decode(x) == t.encode() for x, t in zip(tokens, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in tokens], pa.int32()), _lists(tokens), pa.array(same)], ["doc_id", "n_tokens", "tokens", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id and text of rows with doc_id and tokens; null tokens give an empty text, bytes that aren't UTF-8 the replacement character."""
    ranks = encoded.sparkSession.sparkContext.broadcast(_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(ranks.value)
            texts = [codec.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
