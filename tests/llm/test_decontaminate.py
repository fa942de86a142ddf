import random

import numpy as np

from lexmill.llm import decontaminate as dc
from tests.llm import corpus

ITEMS = "item_id long, text string, source string, doc_id long"


def lcs_table(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint32), rng.integers(0, 6, rng.integers(0, 90)).astype(np.uint32)
        assert dc.lcs(dc.places(a), b.tolist()) == lcs_table(a, b)


def corpus_and_items(rng, n=300):
    items = [" ".join(corpus.words(rng, rng.randrange(14, 60), 3000)) for _ in range(30)]
    texts, leaks = [], set()
    for d in range(n):
        text = corpus.prose(rng, rng.randrange(0, 500), 3000)
        if d % 6 == 0:
            j = rng.randrange(20)
            item = items[j].split()
            if d % 12 == 0:  # a paraphrase: one word in seven is another, one in twelve is left out
                item = [w if rng.random() > 0.14 else "other" for w in item if rng.random() > 0.08]
            text = corpus.prose(rng, rng.randrange(0, 300), 3000) + " " + " ".join(item) + " " + text
            leaks.add((d, j))
        texts.append(text)
    return texts, items, leaks


def brute(texts, items):
    """Pairs whose item is in some stretch of the document by the subsequence check, over all windows of its size."""
    out = set()
    for d, t in enumerate(texts):
        w = t.lower().replace(".", " ").split()
        for j, item in enumerate(x.split() for x in items):
            if len(set(w) & set(item)) < 0.5 * len(set(item)):
                continue
            size = dc.window_size(len(item))[0] * dc.BLOCK
            for at in range(0, max(1, len(w)), dc.BLOCK):
                if lcs_table(item, w[at : at + size]) >= dc.MIN_LCS * len(item):
                    out.add((d, j))
                    break
    return out


def test_recall_and_precision_against_brute_force(spark):
    texts, items, leaks = corpus_and_items(random.Random(2))
    bench = spark.createDataFrame([(j, t, "x", 0) for j, t in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(corpus.docs(spark, texts), bench).collect()}
    true = brute(texts, items)
    assert len(true) > 40 and got <= true and len(got & true) >= 0.95 * len(true)
    assert len({d for d, _ in got} & {d for d, _ in leaks}) >= 0.9 * len(leaks) and {d for d, _ in got} <= {d for d, _ in leaks}


def test_insertions_and_copies_without_their_end(spark):
    rng = random.Random(9)
    items = [" ".join(corpus.words(rng, rng.randrange(16, 60), 3000)) for _ in range(25)]
    texts, kinds = [], {}
    for d in range(150):
        item = items[d % 25].split()
        if d % 3 == 0:  # three words in ten are put in between
            item = [x for w in item for x in ([w, f"extra{rng.randrange(900)}"] if rng.random() < 0.3 else [w])]
        elif d % 3 == 1:
            item = item[: -max(1, len(item) // 7)]
        kinds[d] = d % 3
        texts.append(f"{corpus.prose(rng, rng.randrange(0, 90), 3000)} {' '.join(item)} {corpus.prose(rng, rng.randrange(0, 90), 3000)}")
    texts += [corpus.prose(rng, 300, 3000) for _ in range(150)]
    bench = spark.createDataFrame([(j, t, "x", 0) for j, t in enumerate(items)], ITEMS)
    got = {r.doc_id: r.item_id for r in dc.contaminated(corpus.docs(spark, texts), bench).collect()}
    assert all(i < 150 and j == i % 25 for i, j in got.items())
    for kind, least in ((0, 0.9), (1, 0.98), (2, 1.0)):
        assert sum(k == kind for d, k in kinds.items() if d in got) >= least * 50, kind


def test_items_in_several_blocks_and_passes(spark, monkeypatch):
    texts, items, _ = corpus_and_items(random.Random(4), 60)
    bench = spark.createDataFrame([(j, t, "x", 0) for j, t in enumerate(items)], ITEMS)
    whole = sorted(dc.contaminated(corpus.docs(spark, texts), bench).collect())
    monkeypatch.setattr(dc, "ITEM_BLOCK", 7)
    assert sorted(dc.contaminated(corpus.docs(spark, texts), bench).collect()) == whole
    monkeypatch.setattr(dc, "PASS_ITEMS", 14)
    assert sorted(dc.contaminated(corpus.docs(spark, texts), bench).collect()) == whole


def test_a_thousand_items_are_one_pass(spark):
    rng = random.Random(14)
    items = [" ".join(corpus.words(rng, 24, 9000)) for _ in range(1000)]
    texts = [f"{corpus.prose(rng, 50, 9000)} {items[7 * d]} {corpus.prose(rng, 50, 9000)}" for d in range(100)]
    bench = spark.createDataFrame([(j, t, "x", 0) for j, t in enumerate(items)], ITEMS)
    found = dc.contaminated(corpus.docs(spark, texts), bench)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, 7 * d) for d in range(100)}


def test_one_document_and_texts_in_segments(spark, monkeypatch):
    rng = random.Random(15)
    item = " ".join(corpus.words(rng, 40, 3000))
    bench = spark.createDataFrame([(0, item, "x", 0)], ITEMS)
    assert [r.lcs for r in dc.contaminated(corpus.docs(spark, [item] * 3), bench).collect()] == [40] * 3
    assert dc.contaminated(corpus.docs(spark, [item]), bench).count() == 1
    texts = [f"{corpus.prose(rng, n, 3000)} {item} {corpus.prose(rng, 700, 3000)}" for n in range(900, 1300, 25)]
    whole = sorted(map(tuple, dc.contaminated(corpus.docs(spark, texts), bench).select("doc_id", "item_id", "lcs").collect()))
    assert whole == [(d, 0, 40) for d in range(len(texts))]
    monkeypatch.setattr(dc, "SEGMENT_WORDS", 256)
    assert sorted(map(tuple, dc.contaminated(corpus.docs(spark, texts), bench).select("doc_id", "item_id", "lcs").collect())) == whole


def test_basis_is_that_of_the_exact_decomposition(spark):
    texts, _, _ = corpus_and_items(random.Random(5), 80)
    table = dc.fingerprints(corpus.docs(spark, [t for t in texts for _ in range(3)]))
    weights = dc.latent_weights(*dc.term_frequencies(table), common=1.0)
    basis, values = dc.latent_basis(table, weights)
    rows = []
    for r in table.collect():
        term = np.frombuffer(r.words, np.uint32) & (dc.TERMS - 1)
        for at in range(0, len(term), dc.PASSAGE):
            rows.append(np.bincount(term[at : at + dc.PASSAGE], minlength=dc.TERMS) * weights)
    exact = np.linalg.svd(np.array(rows)[:, np.unique(np.nonzero(rows)[1])], compute_uv=False)
    assert np.allclose(basis.T @ basis, np.eye(dc.RANK), atol=1e-3)
    assert 0.5 * exact[0] < values[0] < 1.5 * exact[0]


def test_answer_column_and_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(0, item, "forty two", "x"), (1, None, None, "x"), (2, "", "y", "x"), (None, item, None, "x")]
    bench = spark.createDataFrame(rows, "item_id long, text string, answer string, source string")
    docs = corpus.docs(spark, [item + " forty two", item, None, "", "unrelated words only"])
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    assert got == {(0, 0)}
    plain = bench.drop("answer")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, plain).collect()} == {(0, 0), (1, 0)}
    assert dc.contaminated(corpus.edges(spark), plain).count() == 0 and dc.contaminated(corpus.empty(spark), plain).count() == 0
    assert dc.contaminated(docs, plain.limit(0)).count() == 0
    assert dc.apply(docs, plain).count() == 3 and dc.apply(corpus.edges(spark), plain).count() == len(corpus.edge_rows())
