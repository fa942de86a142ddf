import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lexmill.llm import prob_minhash as pm
from lexmill.llm.kernels import buffers
from tests.llm import corpus


def shingles(text, n=3):
    w = text.lower().replace(".", " ").split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def jp(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in set(a) & set(b))


def variants(rng, n_groups=12):
    texts = []
    for _ in range(n_groups):
        base = corpus.words(rng, rng.randrange(30, 250), 300)
        for _ in range(rng.randrange(1, 5)):
            rate = rng.choice([0, 0.02, 0.05, 0.08, 0.2])
            texts.append(" ".join(f"new{rng.randrange(9**6)}" if rng.random() < rate else w for w in base))
    return texts


def test_similarity_is_exact():
    texts = variants(random.Random(1))
    data, offsets = buffers(pa.array(texts))
    row, element, weight = pm.elements(data, offsets)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    for i in range(0, len(texts), 2):
        for j in range(len(texts)):
            got = pm.similarity(element[at[i] : at[i + 1]], weight[at[i] : at[i + 1]], element[at[j] : at[j + 1]], weight[at[j] : at[j + 1]])
            assert abs(got - jp(shingles(texts[i]), shingles(texts[j]))) < 1e-9


def test_equal_registers_estimate_similarity():
    texts = variants(random.Random(2), 30) + ["one", "one two", "one one one two", "one"]
    data, offsets = buffers(pa.array(texts))
    row, element, weight = pm.elements(data, offsets, 1)
    sig, has = pm.signatures(row, element, weight, len(texts))
    assert has.all()
    errors = [np.mean(sig[i] == sig[j]) - jp(shingles(texts[i], 1), shingles(texts[j], 1)) for i in range(len(texts)) for j in range(i)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_recall_against_brute_force(spark):
    texts = variants(random.Random(3), 60)
    sets = [shingles(t) for t in texts]
    true = {(i, j) for i in range(len(texts)) for j in range(i) if jp(sets[i], sets[j]) >= pm.THRESHOLD}
    found = {r.doc_id: r.duplicate_of for r in pm.duplicates(corpus.docs(spark, texts)).collect()}
    group = lambda d: found.get(d, d)
    hit = sum(group(i) == group(j) for i, j in true)
    assert hit >= 0.95 * len(true) and len(true) > 50
    parent = list(range(len(texts)))  # and no two of different true groups are joined

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in true:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert all(root(d) == root(g) for d, g in found.items())


def test_shared_passage_hides_no_pair(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**12)}" for _ in range(n)]
    passage, texts = corpus.words(rng, 60), []
    for i in range(90):  # of any two about 0.43 of the shingles are equal, of the pairs 0.55
        own = fresh(40)
        texts.append(" ".join(passage + own))
        if i % 3 == 0:
            texts.append(" ".join(passage + own[:12] + fresh(28)))
    rng.shuffle(texts)
    docs = corpus.docs(spark, texts)
    sets = [set(shingles(t)) for t in texts]
    of_band = {}
    for r in pm.bands(docs).collect():
        of_band.setdefault(r.band, set()).add(r.doc_id)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in {(i, j) for ids in of_band.values() for i in ids for j in ids if i > j}:
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= pm.THRESHOLD:  # no shingle occurs twice
            parent[max(root(i), root(j))] = min(root(i), root(j))
    expected = {i: root(i) for i in range(len(texts)) if root(i) != i}
    assert len(expected) > 20
    assert {r.doc_id: r.duplicate_of for r in pm.duplicates(docs).collect()} == expected


def test_long_chains_have_one_group(spark):
    from lexmill.llm.shared import Scratch

    order = list(range(60))
    random.Random(1).shuffle(order)
    pairs = [(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.doc_id: r.group_id for r in pm.groups(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100}


def test_edges(spark):
    got = pm.duplicates(corpus.edges(spark)).collect()
    assert sorted((r.doc_id, r.duplicate_of) for r in got) == [(6, 5), (8, 7)]
    assert sorted((r.doc_id is None, r.doc_id) for r in pm.apply(corpus.edges(spark)).select("doc_id").collect()) == sorted((r[0] is None, r[0]) for r in corpus.edge_rows() if r[0] not in (6, 8))
    assert pm.duplicates(corpus.empty(spark)).count() == 0 and pm.apply(corpus.empty(spark)).columns == corpus.empty(spark).columns
