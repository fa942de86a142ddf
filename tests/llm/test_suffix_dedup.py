import random

from lexmill.llm import suffix_dedup
from tests.llm import corpus


def brute(texts, least=50):
    """Pairs (later, earlier) of documents that share some `least` words in a row, and the longest such run."""
    toks = [t.lower().replace(".", " ").split() for t in texts]
    out = {}
    for i in range(len(toks)):
        for j in range(len(toks)):
            if i == j:
                continue
            seen = {tuple(toks[j][p : p + least]) for p in range(len(toks[j]) - least + 1)}
            run = best = 0
            for p in range(len(toks[i]) - least + 1):
                run = run + 1 if tuple(toks[i][p : p + least]) in seen else 0
                best = max(best, run and run + least - 1)
            if best:
                out[i, j] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [corpus.prose(rng, rng.randrange(60, 400)) for _ in range(40)]
    for n in (50, 51, 60, 90, 120, 49, 45, 30):  # each passage in three documents
        passage = corpus.prose(rng, n)
        for d in rng.sample(range(40), 3):
            texts[d] = corpus.prose(rng, rng.randrange(0, 80)) + " begin%d " % rng.randrange(10**6) + passage + " end%d. " % rng.randrange(10**6) + texts[d]
    texts.append(texts[7])
    found = suffix_dedup.long_matches(corpus.docs(spark, texts)).cache()
    longest = brute(texts)
    assert all(50 <= r.n_words <= longest[r.doc_id, r.match_doc_id] for r in found.collect())
    assert lengths(found) == {(i, j): n for (i, j), n in longest.items() if i > j}


def lengths(found):
    """Longest match of each pair of documents, later one first."""
    got = {}
    for r in suffix_dedup.pairs(found).collect():
        got[r.doc_id, r.other_doc_id] = max(got.get((r.doc_id, r.other_doc_id), 0), r.n_words)
    return got


def test_nested_copies(spark):
    """Parts of one long passage, cut at random, in many documents: any of them may hold the middle of a match first."""
    rng = random.Random(8)
    passage = corpus.words(rng, 260)
    texts = []
    for i in range(36):
        a = rng.randrange(0, 200)
        b = a + rng.randrange(30, 200)
        texts.append(f"{corpus.prose(rng, rng.randrange(0, 40))} a{i} {' '.join(passage[a:b])} z{i} {corpus.prose(rng, rng.randrange(0, 40))}")
    longest = {(i, j): n for (i, j), n in brute(texts).items() if i > j}
    assert len(longest) > 200
    for batches in (1, 3, 8):
        assert lengths(suffix_dedup.long_matches(corpus.docs(spark, texts), batches=batches)) == longest


def test_three_documents(spark):
    """The middle of a match is first held by a third document, as 40 words that are no match."""
    rng = random.Random(21)
    texts, pairs = [], set()
    for t in range(60):
        left, middle, right = (corpus.prose(rng, n) for n in (12, 40, 12))
        texts += [f"{corpus.prose(rng, 20)} x{t} {middle} y{t}"] + [f"{corpus.prose(rng, 20)} {c}{t} {left} {middle} {right} {c}{c}{t}" for c in "pq"]
        pairs.add((len(texts) - 1, len(texts) - 2))
    assert lengths(suffix_dedup.long_matches(corpus.docs(spark, texts))) == dict.fromkeys(pairs, 64)


def test_family_merges_equal_levels(spark):
    from lexmill.llm.shared import Scratch

    family = suffix_dedup.SuffixFamily(Scratch(spark, "test"), 4)
    rows = lambda *x: spark.createDataFrame(x, "h long, doc_id long")
    found = [sorted(r.h for r in family.append(rows(*x)).distinct().collect()) for x in ([(1, 0), (2, 0), (2, 0), (3, 1)], [(2, 2), (3, 2), (4, 2), (4, 3)], [(4, 4)], [(9, 5), (1, 6)], [(9, 5), (7, 7)])]
    assert found == [[], [2, 3, 4], [4], [1], []]  # 9 is held by document 5 alone
    assert sorted(family.levels) == [0, 2]
    assert sorted(map(tuple, spark.table(family.levels[2]).collect())) == [(1, 0, 6), (2, 0, 2), (3, 1, 2), (4, 2, 4), (9, 5, 5)]
    scan = spark.table(family.levels[0]).join(spark.table(family.levels[2]).hint("merge"), "h")
    assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()
    family.close()


def test_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    shared = corpus.prose(rng, 700)
    texts = [f"{corpus.prose(rng, 3000)} a {shared} b {corpus.prose(rng, 900)}", f"{corpus.prose(rng, 500)} c {shared} d", "x" * 9000 + " " + corpus.prose(rng, 300)]
    whole = sorted(map(tuple, suffix_dedup.long_matches(corpus.docs(spark, texts)).collect()))
    assert whole == [(1, 501, 1201, 0, 3001, 700)]
    in_pieces = suffix_dedup.pieces
    monkeypatch.setattr(suffix_dedup, "pieces", lambda it, overlap, **x: in_pieces(it, overlap, size=2000, **x))
    assert sorted(map(tuple, suffix_dedup.long_matches(corpus.docs(spark, texts)).collect())) == whole


def test_shorter_stretches_of_others_hide_no_match(spark):
    rng = random.Random(11)
    texts, pairs = [], []
    around = lambda p: f"{corpus.prose(rng, 30)} a{rng.randrange(10**9)} {p} z{rng.randrange(10**9)} {corpus.prose(rng, 30)}"
    for trial in range(40):
        inner = corpus.prose(rng, 40)
        left, right = corpus.prose(rng, 8), corpus.prose(rng, 7)
        texts += [around(inner) for _ in range(4)]  # 40 words, which is no match
        pairs.append((len(texts), len(texts) + 1))
        texts += [around(f"{left} {inner} {right}") for _ in range(2)]
    twice = corpus.prose(rng, 30)  # a document's second place, not its first, is the match
    left, right = corpus.prose(rng, 15), corpus.prose(rng, 15)
    pairs.append((len(texts), len(texts) + 1))
    texts += [around(twice) + around(f"{left} {twice} {right}"), around(f"{left} {twice} {right}")]
    got = suffix_dedup.long_matches(corpus.docs(spark, texts)).collect()
    assert {frozenset((r.doc_id, r.match_doc_id)) for r in got} == {frozenset(p) for p in pairs}
    assert all(r.n_words in (55, 60) for r in got) and len(got) == len(pairs)


def test_edges(spark):
    got = suffix_dedup.long_matches(corpus.edges(spark)).collect()
    assert {frozenset((r.doc_id, r.match_doc_id)) for r in got} == {frozenset((5, 6))}
    assert all(r.n_words == 200 for r in got)
    assert suffix_dedup.long_matches(corpus.empty(spark)).count() == 0
