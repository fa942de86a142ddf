import math
import random
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from lexmill import constants as C
from lexmill.operators import chunking, context, search
from lexmill.operators import index as ix
from lexmill.functions.porter import stem
from tests.test_text import plain_tokens


def greedy(text, limit):
    """Chunks of a text by the definition, over byte offsets."""
    raw, at, parts = text.encode(), 0, []
    while at < len(raw):
        end = raw.find(b"\n\n", at)
        end = len(raw) if end < 0 else end + 2
        if raw[at:end].strip(b"\n \t"):
            parts.append((at, end))
        at = end
    out = []
    for a, b in parts:
        if out and out[-1][1] - out[-1][0] + b - a <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [raw[a:b].decode() for a, b in out]


def test_chunks_equal_the_definition(spark):
    rng = random.Random(4)
    texts = ["", "\n\n \t\n\n", "one", "\n\n\n\nlead", "a\n\n\nb\n\n", "x" * 99 + "\n\ny", "é" * 30 + "\n\n" + "é" * 12]
    texts += ["\n\n".join(rng.choice(["", " ", "p" * rng.randrange(1, 40), "q" * 70, "ü" * 9]) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    files = spark.createDataFrame([(f"f{i}.txt", t) for i, t in enumerate(texts)], "file string, text string")
    got = {}
    for r in chunking.chunk_paragraphs(chunking.paragraphs(files), 60).orderBy("n").collect():
        got.setdefault(r.file, []).append(r.text)
    assert got == {f"f{i}.txt": greedy(t, 60) for i, t in enumerate(texts) if greedy(t, 60)}


def test_links_codes_and_ranges(spark):
    files = spark.createDataFrame([("/a/notes.txt", "aaaa bbbb\n\n" * 4), ("/b/notes.txt", "c" * 100), ("/c/nts2.txt", "d")], "file string, text string")
    rows = chunking.chunks(chunking.paragraphs(files), 24).orderBy("chunk_idx").collect()
    assert [r.chunk_idx for r in rows] == list(range(len(rows))) and len({r.chunk_id for r in rows}) == len(rows)
    assert {r.source_file: r.chapter_code for r in rows} == {"/a/notes.txt": "nts", "/b/notes.txt": "nts2x", "/c/nts2.txt": "nts2"}
    a = [r for r in rows if r.source_file == "/a/notes.txt"]
    assert [r.prev_chunk_id for r in a] == [None, a[0].chunk_id] and [r.next_chunk_id for r in a] == [a[1].chunk_id, None]
    assert all(r.token_end - r.token_start == len(r.text.encode()) // 4 for r in rows)
    table = chunking.chunks(chunking.paragraphs(files), 24)
    total = rows[-1].token_end
    covered = [r.chunk_id for s in range(0, total, 7) for r in chunking.token_range(table, s, 7, inclusive=False).collect()]
    assert sorted(covered) == sorted(r.chunk_id for r in rows if r.token_end > r.token_start)


def corpus(seed=1, n=30):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) + rng.choice(["", "s", "ing", "ed"]) for _ in range(120)]
    return [(i, f"f{i % 3}.txt", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in sorted(range(n), key=lambda i: i % 3)]


def plain_index(rows):
    """Keywords of each chunk by the definition: own words, at most 50 bigrams, and five rare words of each neighbour."""
    own = {}
    for i, _, text in rows:
        toks = plain_tokens(text)
        tf = Counter(toks)
        big = Counter(f"{a}_{b}" for a, b in zip(toks, toks[1:]))
        own[i] = dict(tf) | dict(sorted(big.items(), key=lambda x: (-x[1], x[0]))[: C.BIGRAMS_PER_CHUNK])
    df = Counter(k for kws in own.values() for k in kws)
    full = {i: set(k) for i, k in own.items()}
    place = {i: f for i, f, _ in rows}
    for i in own:
        for j in (i - 1, i + 1):
            if place.get(j) == place[i]:
                full[i] |= set(sorted((k for k in own[j] if "_" not in k), key=lambda k: (df[k], k))[: C.NEIGHBOUR_KEYWORDS])
    return own, full


def plain_two_phase(full, query, k=C.TOP_K):
    terms = list(dict.fromkeys(plain_tokens(query)))
    stems = list(dict.fromkeys(map(stem, terms)))
    df_kw = Counter(x for kws in full.values() for x in kws)
    has = {i: {stem(x) for x in kws if not ("_" in x and df_kw[x] <= 1)} for i, kws in full.items()}
    n, avg = len(full), sum(map(len, full.values())) / len(full)
    scores = {}
    for s in stems:
        df = sum(s in x for x in has.values())
        for i, x in has.items():
            if s in x:
                idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                scores[i] = scores.get(i, 0) + idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(full[i]) / avg))
    if len(scores) > k:
        for i in scores:
            cov = sum(s in {stem(x) for x in full[i]} for s in stems) / len(stems)
            exact = sum(t in full[i] for t in terms)
            scores[i] *= (1 + 0.8 * cov * cov) * (1 + min(0.25 * exact, 0.75))
    return sorted(((round(v, 6), i) for i, v in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


def build(spark, rows):
    c = spark.createDataFrame([(i, f, i, f"c{i}", t) for i, f, t in rows], "chunk_idx long, source_file string, n long, chunk_id string, text string")
    return ix.Index.create(c, tempfile.mkdtemp())


def test_propagation_and_two_phase_against_plain_python(spark, tmp_path):
    rows = [(n, f, t) for n, (_, f, t) in enumerate(corpus())]
    own, full = plain_index(rows)
    c = spark.createDataFrame([(i, f, i, f"c{i}", t) for i, f, t in rows], "chunk_idx long, source_file string, n long, chunk_id string, text string")
    index = ix.Index.create(c, str(tmp_path))
    got = {}
    for r in index.doc_keywords.collect():
        got.setdefault(r.chunk_idx, set()).add(r.keyword)
    assert got == full
    queries = [rows[3][2][:60], "the of and", "", rows[7][2], "zzzz unknown", " ".join(rows[1][2].split()[:2])]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    again = ix.Index.read(spark, str(tmp_path))
    hits = {}
    for r in search.two_phase(again, q).orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append((round(r.score, 6), r.chunk_idx))
    for i, text in enumerate(queries):
        expected = plain_two_phase(full, text)
        assert [x for _, x in hits.get(i, [])] == [x for _, x in expected] and all(abs(a[0] - b[0]) < 1e-5 for a, b in zip(hits.get(i, []), expected))


def test_segments_early_stop_and_merge(spark):
    rows = [(n, f, t) for n, (_, f, t) in enumerate(corpus(2))]
    c = spark.createDataFrame([(i, f, i, f"c{i}", t, i // 10) for i, f, t in rows], "chunk_idx long, source_file string, n long, chunk_id string, text string, segment_id int")
    index = ix.Index.create(c, tempfile.mkdtemp())
    q = spark.createDataFrame([(1, rows[0][2][:80])], "query_id long, query string")
    pick = lambda h: [(r.segment_id, r.chunk_idx, round(r.score, 6)) for r in h.orderBy("rank").collect()]
    assert pick(search.sequential_segments(index, q)) == pick(search.multi_segment(index, q))
    assert {s for s, _, _ in pick(search.sequential_segments(index, q, early=0.1))} == {0}
    merged = search.merged(search.multi_segment(index, q, 3), search.multi_segment(index, q, 5))
    assert pick(merged) == pick(search.multi_segment(index, q, 5))


def test_coherence_threshold_and_tiers(spark):
    hits = spark.createDataFrame([(1, 0, 1, 10.0, 1), (1, 0, 2, 9.9, 2), (1, 0, 3, 9.8, 3), (1, 0, 4, 2.0, 4)], "query_id long, segment_id int, chunk_idx long, score double, rank int")
    sources = spark.createDataFrame([(0, 1, ""), (0, 2, "a"), (0, 3, "a"), (0, 4, None)], "segment_id int, chunk_idx long, source_file string")
    out = search.source_coherence(hits, sources).orderBy("rank").collect()
    assert [(r.chunk_idx, round(r.score, 4)) for r in out] == [(2, 10.395), (3, 10.29), (1, 10.0), (4, 2.0)]
    assert search.score_threshold(search.source_coherence(hits, sources)).count() == 3
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 99, 100, 999, 10**6, 10**11)], "n long").select(search.dynamic_top_k(F.col("n")).alias("k")).collect()
    assert [r.k for r in sizes] == [8, 3, 3, 8, 8, 24, 150]


def test_judge_that_fails_is_content(spark):
    index = build(spark, [(n, f, t) for n, (_, f, t) in enumerate(corpus(3))])
    text = corpus(3)[0][2][:50]

    def one(query, k):
        return search.two_phase(index, spark.createDataFrame([(1, query)], "query_id long, query string"), k)

    def broken(question, previews):
        raise TimeoutError

    plain = one(text, 5).count()
    assert search.refine(one, text, 5, lambda hits: [], broken).count() == plain
    calls = []
    search.refine(one, text, 5, lambda hits: [], lambda question, previews: calls.append(1) or "REFINE: ").count()
    assert len(calls) == C.REFINE_ROUNDS


def test_context(spark):
    rows = [(n, "f", f"text {n}") for n in range(6)]
    c = build(spark, rows).chunks
    ids = spark.createDataFrame([("c0",), ("c3",), ("none",)], "chunk_id string")
    near = context.adjacent(c, ids, 9).orderBy("chunk_id", "distance").collect()
    assert [(r.chunk_id, r.near_id) for r in near] == [("c0", f"c{i}") for i in range(4)] + [("c3", f"c{i}") for i in range(6)]
    r = context.reconstruct(c, spark.createDataFrame([("r", ["c2", "no", "c1"]), ("e", [])], "request_id string, chunk_ids array<string>"))
    got = {x.request_id: x for x in r.collect()}
    assert got["r"].content == "[c2]\ntext 2\n\n[c1]\ntext 1" and got["e"].content == "" and got["e"].ratio == 0.0
    hits = spark.createDataFrame([(1, "c1", "q", "text 1", 2.0, 1), (1, "c2", "q", "text 2", 1.0, 2)], "query_id long, chunk_id string, query string, text string, score double, rank int")

    def broken(queries, texts):
        raise ValueError

    assert context.rerank(hits, broken).orderBy("rank").collect()[0].chunk_id == "c1"
    assert context.rerank(hits, lambda q, t: [float(x[-1]) for x in t]).orderBy("rank").collect()[0].chunk_id == "c2"
    assert context.scan(hits, lambda q, t: False).count() == 2 and context.scan(hits, lambda q, t: t.endswith("2")).first().chunk_id == "c2"


def test_refined_search_covers_every_item(spark):
    from lexmill.plans import queries

    d = "/root/testdata/sf0.001"
    i, items = queries.index(spark, d), queries.items(spark, d)
    got = {}
    for r in queries.refined_search(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_idx, r.score))
    searched = {r.query_id for r in search.two_phase(i, items).select("query_id").distinct().collect()}
    assert set(got) == searched and len(searched) > 1
    item = items.orderBy(F.desc("query_id")).first()  # and each as by itself
    calls = []
    one = lambda text, k: search.two_phase(i, spark.createDataFrame([(item.query_id, text)], "query_id long, query string"), k)
    texts = lambda hits: [r.text[: C.JUDGE_CHARS] for r in i.chunks.where(F.col("chunk_idx").isin([h.chunk_idx for h in hits])).orderBy("chunk_idx").collect()]
    alone = search.refine(one, item.query, C.TOP_K, texts, lambda q, p: calls.append(q) or ("REFINE: of the " + p[0] if len(calls) == 1 and p else "FOUND"))
    assert sorted(got[item.query_id]) == [(r["rank"], r.chunk_idx, round(r.score, 6)) for r in alone.orderBy("rank").collect()]


def test_segment_built_alone_equals_its_part_of_a_joint_build(spark):
    rows = [(n, f, t) for n, (_, f, t) in enumerate(corpus(5))]
    table = lambda part: spark.createDataFrame([(i, f, i, f"c{i}", t, i // 10) for i, f, t in part], "chunk_idx long, source_file string, n long, chunk_id string, text string, segment_id int")
    joint = ix.Index.create(table(rows), tempfile.mkdtemp())
    for s in range(3):
        alone = ix.Index.create(table([r for r in rows if r[0] // 10 == s]), tempfile.mkdtemp())
        for name in ix.Index.TABLES:
            part = getattr(joint, name).where(F.col("segment_id") == s)
            assert sorted(map(str, part.collect())) == sorted(map(str, getattr(alone, name).select(*part.columns).collect())), name
        ranked = lambda i: sorted(map(str, ix.ranked_by_tf2idf(i.doc_keywords, i.chunks).where(F.col("segment_id") == s).select("chunk_idx", "keyword", "kw_rank").collect()))  # noqa: B023, E731
        assert ranked(joint) == ranked(alone)


def test_each_query_stops_for_itself(spark):
    rows = [(0, "a", "kestrel kestrel heron"), (1, "b", "otter badger " * 3 + "kestrel"), (2, "c", "badger sparrow otter")]
    c = spark.createDataFrame([(i, f, i, f"c{i}", t, i) for i, f, t in rows], "chunk_idx long, source_file string, n long, chunk_id string, text string, segment_id int")
    index = ix.Index.create(c, tempfile.mkdtemp())
    texts = {1: "kestrel", 2: "otter badger", 3: "sparrow"}
    together = spark.createDataFrame(list(texts.items()), "query_id long, query string")
    hits = lambda q: sorted((r.query_id, r.segment_id, r.chunk_idx, r.rank) for r in search.sequential_segments(index, q, early=0.1).collect())
    alone = [h for q in texts.items() for h in hits(spark.createDataFrame([q], "query_id long, query string"))]
    assert hits(together) == sorted(alone)
    assert {(q, s) for q, s, _, _ in alone} == {(1, 0), (2, 1), (3, 2)}


def test_containing_is_what_contains_says(spark):
    rng = random.Random(3)
    hay = [" ".join(rng.choice(["Alpha", "beta-gamma", "d", "é", "x1", "longword"]) for _ in range(12)) for _ in range(60)]
    needles = [h[a : a + rng.randrange(1, 25)].lower() for h in hay[:30] for a in (rng.randrange(20),)] + ["longword", "ha be", "zz", " "]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(hay)], "chunk_idx long, text string")
    q = spark.createDataFrame(list(enumerate(needles)), "query_id long, needle string")
    got = {(r.query_id, r.chunk_idx) for r in context.containing(c, q).collect()}
    assert got == {(j, i) for j, n in enumerate(needles) for i, t in enumerate(hay) if n in t.lower()}
