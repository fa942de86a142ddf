import random

import numpy as np

from lexmill.llm import quality_classifier as qc
from tests.llm import corpus

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(spark, n=240, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(w + rng.choice(["!!", "%%%", "###"]) if bad else w for w in corpus.words(rng, rng.randrange(20, 400), 500))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0, "clash"))
    return spark.createDataFrame(docs, corpus.DOC), spark.createDataFrame(labels, LABELS), labels


def test_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    model = qc.fit(docs.where("doc_id < 160"), labels)
    got = {r.doc_id: r for r in qc.classify(docs, model).collect()}
    right = [got[i].keep == bool(q) for i, q, *_ in rows if i >= 160]
    assert np.mean(right) > 0.95
    scores = np.array([got[i].score for i, *_ in rows if i >= 160])
    assert ((scores > 0) & (scores < 1)).all()


def test_calibration_recovers_a_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    scale, slope, intercept = qc.calibrate(x, y, np.ones(20000))
    assert abs(slope / scale - 2) < 0.1 and abs(intercept + 1) < 0.1


def test_late_parts_of_long_texts_count(spark):
    docs, labels, _ = labelled(spark)
    pair_model = qc.fit(docs, labels)
    pair = qc.compressors(pair_model["good"], pair_model["bad"])
    rng = random.Random(4)
    good = " ".join(corpus.words(rng, 20000, 500)).encode()
    junk = " ".join(w + "!!" for w in corpus.words(rng, 20000, 500)).encode()
    assert qc.statistic(pair, good) > qc.statistic(pair, good + junk) > qc.statistic(pair, junk)


def test_edges(spark):
    docs, labels, _ = labelled(spark)
    model = qc.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0, "x"), (1, None, 0, None), (2, 0, 0, ""), (2, 1, 0, "")], LABELS)))
    out = qc.classify(corpus.edges(spark), model).collect()
    assert len(out) == len(corpus.edge_rows()) and {r.statistic for r in out if r.doc_id in (1, 2)} == {0.0}
    assert qc.classify(corpus.empty(spark), model).count() == 0
    assert qc.fit(corpus.empty(spark), labels) is None and qc.fit(docs, labels.where("quality = 1")) is None
    none = qc.classify(docs, None).collect()
    assert all(r.keep and r.score is None for r in none)


def test_long_labelled_text_keeps_no_other_out(spark):
    docs, labels, rows = labelled(spark)
    rng = random.Random(7)
    longs = [(1000 + i, " ".join(corpus.words(rng, 60000, 500)), "en", "s", 0) for i in range(6)]
    more = docs.unionByName(spark.createDataFrame(longs, corpus.DOC))
    marks = labels.unionByName(spark.createDataFrame([(i, 1, 0, "x") for i, *_ in longs], LABELS))
    for limits in ({"max_bytes": 1 << 18, "max_text": 1 << 14}, {"max_bytes": 1 << 12, "max_text": 1 << 12}):
        model = qc.fit(more, marks, **limits)
        assert model is not None
    model = qc.fit(more, marks, max_bytes=1 << 20, max_text=1 << 14)
    got = {r.doc_id: r.keep for r in qc.classify(docs, model).collect()}
    assert np.mean([got[i] == bool(q) for i, q, *_ in rows]) > 0.95
    text = bytes(range(256)) * 1000
    cut = qc.spread(text, 8192)
    assert len(cut) == 8192 and cut[:2048] == text[:2048] and cut[-2048:] == text[-2048:] and qc.spread(b"abc", 8192) == b"abc"


def test_scores_against_plain_sizes_and_a_plain_fit(spark):
    import math

    import zstandard as zstd

    docs, labels, rows = labelled(spark, 120, 5)
    model = qc.fit(docs, labels)
    got = {r.doc_id: r for r in qc.classify(docs, model).collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    held, trained = [], {0: [], 1: []}
    for q in (0, 1):
        ids = sorted(i for i, x, *_ in rows if x == q)
        held += [(i, q) for i in ids[2::3]]
        trained[q] = [texts[i] for n, i in enumerate(ids) if n % 3 != 2]
    for q, name in ((1, "good"), (0, "bad")):
        assert model[name] == zstd.train_dictionary(qc.DICT_BYTES, [t[a : a + qc.BLOCK] for t in trained[q] for a in range(0, len(t), qc.BLOCK)]).as_bytes()

    def size(t, raw):
        c = zstd.ZstdCompressor(level=qc.LEVEL, dict_data=zstd.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(t[a : a + qc.BLOCK])) for a in range(0, len(t), qc.BLOCK))

    x = {i: (size(t, model["bad"]) - size(t, model["good"])) / len(t) for i, t in texts.items()}
    assert all(abs(got[i].statistic - v) < 1e-12 for i, v in x.items())
    share = {q: sum(r[1] == q for r in rows) / len(rows) for q in (0, 1)}
    n = {q: sum(y == q for _, y in held) for q in (0, 1)}
    goal = {1: (n[1] + 1) / (n[1] + 2), 0: 1 / (n[0] + 2)}
    scale = float(np.std([x[i] for i, _ in held]))
    slope = cut = 0.0
    for _ in range(60000):  # plain gradient ascent of the same likelihood
        da = db = 0.0
        for i, y in held:
            z = x[i] / scale
            e = share[y] / n[y] * len(held) * (goal[y] - 1 / (1 + math.exp(-(slope * z + cut))))
            da, db = da + e * z, db + e
        da, db = da - 1e-3 * slope, db - 1e-3 * cut
        slope, cut = slope + 0.05 * da, cut + 0.05 * db
        if abs(da) + abs(db) < 1e-7:
            break
    assert all(abs(got[i].score - 1 / (1 + math.exp(-(slope * v / scale + cut)))) < 1e-3 for i, v in x.items())
