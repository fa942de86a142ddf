import random
import re

from lexmill.llm import substring_dedup
from tests.llm import corpus

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def sentences(text):
    return [s for s in re.findall(r".*?(?:[.!?](?![0-9A-Za-z\u0080-\U0010ffff])|\n|\Z)", text, re.S) if s]


def brute(texts, n=2, least=15):
    seen, out = {}, {}
    parts = [sentences(t) for t in texts]
    for d, ss in enumerate(parts):
        real = [i for i, s in enumerate(ss) if WORD.search(s)]
        gone = set()
        spans = []
        for k in range(len(real)):
            run, taken = (), 0
            while k + taken < len(real) and (taken < n or len(run) < least):
                run += tuple(WORD.findall(ss[real[k + taken]]))
                taken += 1
            if taken >= n and len(run) >= least:
                spans.append((k, k + taken, run))
        for k in range(len(real) - n, -1, -1):
            run = tuple(w for i in real[k:] for w in WORD.findall(ss[i]))
            if len(run) >= least:
                if (k, len(real), run) not in spans:
                    spans.append((k, len(real), run))
                break
        for a, b, run in spans:
            if run in seen:
                gone |= set(real[a:b])
            else:
                seen[run] = d
        if gone:
            out[d] = ("".join(s for i, s in enumerate(ss) if i not in gone), len(real), len(gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    texts = [corpus.prose(rng, rng.randrange(0, 300)) for _ in range(40)]
    for _ in range(12):
        passage = corpus.prose(rng, 60)
        for d in rng.sample(range(40), 3):
            texts[d] = corpus.prose(rng, 20) + ".\n" + passage + ". " + texts[d]
    texts += [texts[3], "Ü é. " * 40, "Ü é. " * 40, "a. b. c. a. b. c.", "It was 3.5 today!) Then (no.) more words in this one.&&& And so on, eleven twelve thirteen. End", "x It was 3.5 today!) Then (no.) more words in this one.&&& And so on, eleven twelve thirteen. End", " ".join(f"Q{i}!!" for i in range(40)), "x. " + " ".join(f"Q{i}!!" for i in range(40)), "x" * 5, "", "...\n\n!"]
    expected = brute(texts)
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in substring_dedup.remove_repeats(corpus.docs(spark, texts)).collect()}
    assert got == expected and len(got) > 15


def test_edges(spark):
    got = substring_dedup.remove_repeats(corpus.edges(spark)).collect()
    assert [(r.doc_id, r.n_sentences, r.n_removed, list(r.first_doc_ids)) for r in got] == [(6, 23, 23, [5])]
    assert substring_dedup.remove_repeats(corpus.empty(spark)).count() == 0


def test_texts_of_one_id_are_cut_by_their_own_runs(spark):
    rng = random.Random(6)
    shared, a, b = (corpus.prose(rng, 60) + "." for _ in range(3))
    rows = [(1, shared), (2, f"{shared}\n{a}"), (2, f"{b}\n{a}"), (2, f"{b}\n{a}"), (3, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], corpus.DOC)
    got = sorted((r.doc_id, r.text.strip()) for r in substring_dedup.remove_repeats(docs).collect())
    first, second = sorted((rows[1][1], rows[2][1]), key=lambda t: spark.range(1).selectExpr(f"hash('{t}')").first()[0])
    unique = {rows[1][1]: "", rows[2][1]: b}  # what the text that comes second keeps: shared came first in document 1
    expected = [(2, a)] if first == rows[2][1] else [(2, a), (2, b), (2, b)]
    assert got == sorted([*expected, (3, "")]), (first == rows[2][1], unique, second)
