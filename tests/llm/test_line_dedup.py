import random

from lexmill.llm import line_dedup
from tests.llm import corpus


def brute(rows):
    """keep flags of each (doc_id, text)."""
    first = {}
    for doc_id, text in sorted({(d, t or "") for d, t in rows if d is not None}):
        for pos, line in enumerate(text.split("\n")):
            first.setdefault(line.strip(" \t\r\f\x0b"), (doc_id, pos))
    return {(d, t or ""): [not x.strip(" \t\r\f\x0b") or first[x.strip(" \t\r\f\x0b")] == (d, p) for p, x in enumerate((t or "").split("\n"))] for d, t in rows if d is not None}


def flags(code):
    out, keep = [], True
    for n in map(int, code.split()):
        out += [keep] * n
        keep = not keep
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = [corpus.prose(rng, 6) for _ in range(150)] + ["hot"] * 40 + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    got = line_dedup.bitmaps(corpus.docs(spark, texts).repartition(7)).collect()
    expected = brute(list(enumerate(texts)))
    assert len(got) == 60
    for r in got:
        keep = expected[r.doc_id, texts[r.doc_id]]
        assert flags(r.keep_runs) == keep and (r.n_lines, r.n_kept) == (len(keep), sum(keep))
    kept = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.apply(corpus.docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        keep = expected[d, t]
        lines = [x for x, k in zip(t.split("\n"), keep) if k]
        assert kept.get(d) == (("\n".join(lines), len("\n".join(lines))) if lines else None)


def test_a_line_spread_over_many_partitions_is_kept_once(spark):
    texts = ["same\n" + str(i) for i in range(4000)]
    got = line_dedup.bitmaps(corpus.docs(spark, texts))
    assert got.where("keep_runs = '2'").select("doc_id").collect() == [(0,)] and got.where("keep_runs = '0 1 1'").count() == 3999


def test_edges(spark):
    got = {(r.doc_id, r.n_lines, r.keep_runs) for r in line_dedup.bitmaps(corpus.edges(spark)).collect()}
    assert {(1, 1, "1"), (2, 1, "1"), (3, 3, "3"), (5, 1, "1"), (6, 1, "0 1"), (7, 1, "1"), (8, 1, "0 1")} <= got
    out = line_dedup.apply(corpus.edges(spark))
    assert out.columns == corpus.edges(spark).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == sorted((r[0] is None, r[0]) for r in corpus.edge_rows() if r[0] not in (6, 8))
    assert line_dedup.bitmaps(corpus.empty(spark)).count() == 0 and line_dedup.apply(corpus.empty(spark)).count() == 0
