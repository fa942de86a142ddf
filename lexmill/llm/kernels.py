"""Vectorised text kernels: they work on the byte buffers of whole Arrow columns, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
ALL = U64(0xFFFFFFFFFFFFFFFF)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_P))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows into them; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run doesn't cross from a row to the next."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | cut[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; with keep, of the bytes where it is True only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if keep is not None:
        at = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=at[1:])
        data, starts, ends = data[keep], at[starts], at[ends]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(_P, len(data)), out=sums[1:])
    inverse = powers(_inverse(_P), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters, digits and bytes beyond ASCII): starts, ends, row, hash. Texts should be in lower case."""
    if len(data) <= CUT_BYTES:
        starts, ends = runs(_WORD[data], offsets)
        return starts, ends, row_of(starts, offsets), span_hashes(data, starts, ends)
    parts = []
    for a, b, _ in cuts(data, 0):
        own = offsets[(offsets > a) & (offsets < b)] - a
        starts, ends, _, h = words(data[a:b], np.concatenate(([0], own, [b - a]))) if b - a <= CUT_BYTES else _one_by_one(data[a:b], own)
        parts.append((starts + a, ends + a, h))
    starts, ends, h = (np.concatenate(x) for x in zip(*parts))
    return starts, ends, row_of(starts, offsets), h


def _one_by_one(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() of a stretch that can't be cut, for it has a word longer than CUT_BYTES."""
    starts, ends = runs(_WORD[data], np.concatenate(([0], own, [len(data)])))
    return starts, ends, np.zeros(len(starts), np.int64), span_hashes(data, starts, ends)


CUT_BYTES = 4 << 20


def cuts(data: np.ndarray, overlap: int, size: int | None = None) -> Iterator[tuple[int, int, int]]:
    """Stretches of about `size` bytes that end between words and have `overlap` words in common: first byte, last byte, number of the first word."""
    start, base, end, size = 0, 0, len(data), size or CUT_BYTES
    while True:
        stop, reach = end, size
        while start + reach < end:
            mask = _WORD[data[start : start + reach]]
            begins = np.flatnonzero(mask & ~np.concatenate(([False], mask[:-1])))
            if len(begins) > overlap + 1:  # the last word may go on beyond
                stop = start + int(begins[-1])
                break
            reach *= 2
        yield start, stop, base
        if stop == end:
            return
        base, start = base + len(begins) - 1 - overlap, start + int(begins[-1 - overlap])


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all of them are in its row. Both have max(0, n - k + 1) entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers(_inverse(_Q), n)), row[:n] == row[k - 1 :]


def _sliding(x: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over x[i : i + w] for each i; beyond the end is pad."""
    out, width = x.copy(), 1
    while width < w:
        step = min(width, w - width)
        shifted = np.full(len(out), pad, dtype=out.dtype)
        if step < len(out):
            shifted[:-step] = out[step:]
        out = op(out, shifted)
        width += step
    return out


def leftmost_least(x: np.ndarray, w: int) -> np.ndarray:
    """For each i the index of the least of x[i : i + w] by its upper 40 bits, the leftmost of equal ones. For fewer than 2 ** 24 entries."""
    low = U64((1 << 24) - 1)
    return (_sliding((x & ~low) | np.arange(len(x), dtype=np.uint64), w, np.minimum, ALL) & low).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def word_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums for word_spans()."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=sums[1:])
    return sums


def word_spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words [start, end) for each span, equal for equal sequences of words."""
    inverse = powers(_inverse(_Q), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences that have a word: byte starts and ends, row, first and last word (exclusive), and prefix sums of the words' hashes.

    A sentence ends with its line, or after . ! or ? that no letter or digit follows.
    """
    ws, we, wrow, wh = words(data, offsets)
    n = len(data)
    last = np.zeros(n, dtype=bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    following = np.ones(n, dtype=bool)
    following[:-1] = ~_WORD[data[1:]]
    ends = np.flatnonzero((_STOP[data] & following) | (data == 10) | last) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    w0, w1 = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    has = w1 > w0
    return starts[has], ends[has], row_of(starts[has], offsets), w0[has], w1[has], word_sums(wh)
