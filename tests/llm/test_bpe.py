import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bpe
from tests.llm import corpus

CODEC = bpe.Codec(bpe._ranks(bpe.RANKS), leaf_chars=7)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\t\r.,!1é漢 \x1c​\U0001f600stRE"), max_size=120) | st.text(max_size=80))
def test_tree_equals_whole_encoding(text):
    tokens = CODEC.encode(text)
    assert tokens.tolist() == CODEC.encoding.encode_ordinary(text)
    assert CODEC.decode(tokens, leaf_tokens=3).decode() == text


def test_long_texts_without_a_stable_place():
    for text in ("x" * 5000, " " * 3000, "ab" * 900 + " " + "c" * 1000):
        assert CODEC.encode(text).tolist() == CODEC.encoding.encode_ordinary(text)


def test_only_the_window_is_encoded_anew(monkeypatch):
    rng = random.Random(1)
    left, right = corpus.prose(rng, 3000) + " un", "broken " + corpus.prose(rng, 3000)
    a, b = CODEC.leaf(left), CODEC.leaf(right)
    seen = []
    leaf = CODEC.leaf
    monkeypatch.setattr(CODEC, "leaf", lambda t: seen.append(t) or leaf(t))
    assert CODEC.join(left, a, right, b).tolist() == CODEC.encoding.encode_ordinary(left + right)
    assert max(map(len, seen)) < 80


def test_round_trip_and_edges(spark):
    out = bpe.encode(corpus.edges(spark)).collect()
    assert len(out) == len(corpus.edge_rows()) and all(r.round_trip and r.n_tokens == len(r.tokens) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    back = bpe.decode(bpe.encode(corpus.edges(spark))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in corpus.edge_rows())
    assert bpe.encode(corpus.empty(spark)).count() == 0
    assert isinstance(CODEC.encoding, tiktoken.Encoding)
