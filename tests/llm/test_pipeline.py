import random

import corpus_pipeline
import tiktoken
from lexmill.llm import bpe
from tests.llm import corpus


def write_tables(spark, d, n=240):
    """Clean documents; junk; line copies, near copies and leaks of clean ones, each in a range of ids of its own."""
    rng = random.Random(12)
    docs, labels, items = {}, [], []
    for i in range(n):
        bad = i % 4 == 0
        text = "\n".join(" ".join(w + rng.choice(["!!", "%%%", "###"]) if bad else w for w in corpus.words(rng, rng.randrange(8, 30), 3000)) for _ in range(rng.randrange(3, 9)))
        docs[i] = text
        labels.append((i, int(not bad), 0))
    clean = [i for i in docs if i % 4]
    for j, i in enumerate(clean[:20]):  # near copies: one word in 30 is another
        docs[1000 + j] = "\n".join(" ".join("new" if rng.random() < 0.03 else w for w in line.split()) + f" end{j}" for line in docs[i].split("\n"))
    for j, i in enumerate(clean[20:40]):  # one line is another document's
        docs[2000 + j] = docs[i].split("\n")[0] + "\n" + "\n".join(" ".join(corpus.words(rng, 20, 3000)) for _ in range(4))
    for j in range(15):  # leaks
        item = " ".join(corpus.words(rng, 30, 3000))
        items.append((j, item))
        docs[3000 + j] = " ".join(corpus.words(rng, 60, 3000)) + "\n" + item + "\n" + " ".join(corpus.words(rng, 60, 3000))
    docs[4000] = docs[clean[41]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], corpus.DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return docs, clean


def test_pipeline_against_brute_force(spark, tmp_path):
    d = str(tmp_path)
    docs, clean = write_tables(spark, d)
    seen, expected = set(), {}
    for i in sorted(docs):
        if i < 1000 and i % 4 == 0:
            continue  # junk
        lines = []
        for line in docs[i].split("\n"):
            if line not in seen:
                lines.append(line)
            seen.add(line)
        if lines and not (1000 <= i < 2000 or 3000 <= i < 4000):
            expected[i] = "\n".join(lines)
    assert 4000 not in expected and set(clean) <= set(expected)
    ranks = bpe.Codec(bpe._ranks(bpe.RANKS)).encoding
    assert isinstance(ranks, tiktoken.Encoding)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(expected)
    assert all(got[i].tokens == ranks.encode_ordinary(t) and got[i].round_trip for i, t in expected.items())


def test_all_stages_but_the_last_keep_the_columns(spark, tmp_path):
    d = str(tmp_path)
    write_tables(spark, d, 80)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    edge = corpus.edges(spark)
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, edge, d).columns == edge.columns, name
        assert stage(spark, edge.limit(0), d).count() == 0, name
