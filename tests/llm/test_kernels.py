import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lexmill.llm import kernels
from lexmill.llm import prob_minhash as pm
from tests.llm import corpus


def texts(rng):
    out = [corpus.prose(rng, rng.randrange(0, 200)) for _ in range(20)]
    return [*out, "", None, "x" * 900, "é" * 300 + " ü", " \n ", corpus.prose(rng, 2000)]


def test_words_cut_by_cut_are_the_words(monkeypatch):
    data, offsets = kernels.buffers(pa.array(texts(random.Random(1))))
    whole = kernels.words(data, offsets)
    for size in (50, 257, 5000):
        monkeypatch.setattr(kernels, "CUT_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(kernels.words(data, offsets), whole))


def test_cuts_overlap_by_words():
    text = corpus.prose(random.Random(2), 500).encode()
    data, words = np.frombuffer(text, np.uint8), text.decode().split()
    for overlap in (0, 3, 40):
        end = 0
        for a, b, base in kernels.cuts(data, overlap, 300):
            part = text[a:b].decode().split()
            assert part == words[base : base + len(part)] and (base == 0 or base == end - overlap)
            end = base + len(part)
        assert end == 500


def test_shingles_and_registers_piece_by_piece(monkeypatch):
    text = corpus.prose(random.Random(3), 3000, 90)
    data, offsets = kernels.buffers(pa.array([text]))
    row, element, weight = pm.elements(data, offsets)
    registers, _ = pm.signatures(row, element, weight, 1)
    monkeypatch.setattr(pm, "CUT_BYTES", 500)
    monkeypatch.setattr(kernels, "CUT_BYTES", 500)
    monkeypatch.setattr(pm, "AT_ONCE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(pm.elements(data, offsets), (row, element, weight)))
    assert np.array_equal(pm.signatures(row, element, weight, 1)[0], registers)


def test_memory_of_a_very_long_text_is_bounded():
    """A fixed amount for the piece at hand, and for shingles some bytes for each byte of text: 100 MB stay below 1 GB."""
    text = (corpus.prose(random.Random(4), 40000) + " ") * 96
    data, offsets = kernels.buffers(pa.array([text]))
    assert len(data) > 20 << 20
    for call, share in ((lambda: pm.elements(data, offsets), 5), (lambda: [len(kernels.words(data[a:b], np.array([0, b - a]))) for a, b, _ in kernels.cuts(data, 49)], 0)):
        tracemalloc.start()
        call()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < share * len(data) + (220 << 20), (peak, len(data))
