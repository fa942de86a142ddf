"""Queries against their SQL on small tables with odd rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.operators import chunking, search
from lexmill.operators import index as ix


def same(spark, folder, *names):
    """Whether the rows of queries are those of their SQL in DuckDB over the same folder."""
    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}/*.parquet')")
    for name in names:
        got = sorted(map(repr, (tuple(r) for r in entry.queries()[name](spark, str(folder)).collect())))
        assert got == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall())), name


@pytest.fixture()
def folder(tmp_path):
    return tmp_path


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))


def test_blank_documents_add_nothing_to_a_chunk(spark, folder):
    words = lambda i: f"heron{i} otter badger. " * 90
    texts = [words(i) if i % 4 else ["", " \n\t ", None, "\n\n"][i // 4 % 4] for i in range(60)]
    documents(spark, folder, [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)])
    same(spark, folder, "paragraph_chunks", "segment_ranges", "dynamic_chunks", "reconstructed", "chunk_lookup")


def test_documents_under_one_id_are_not_multiplied(spark):
    d = spark.createDataFrame([(1, "a", "x" * 30), (1, "a", "y" * 40), (1, "a", "y" * 40), (2, "a", "z" * 30), (2, "a", "z" * 30)], "doc_id long, source string, text string")
    rows = chunking.chunks(chunking.source_paragraphs(d), 80, blanks=False).orderBy("chunk_idx").collect()
    assert sorted("".join(r.text for r in rows).split("\n\n")) == sorted(["x" * 30, "y" * 40, "y" * 40, "z" * 30, "z" * 30])
    assert all(r.token_end - r.token_start == len(r.text) // 4 for r in rows)


def small_index(spark, tmp_path, segments=3):
    texts = [f"heron{i % 3} otter badgers badger kestrel{i} sparrow. " * (1 + i % 4) for i in range(24)]
    c = spark.createDataFrame([(i, f"f{i // 12}", i, f"c{i}", t, i * segments // 24) for i, t in enumerate(texts)], "chunk_idx long, source_file string, n long, chunk_id string, text string, segment_id int")
    return ix.Index.create(c, str(tmp_path))


def test_sequential_search_is_planned_without_a_job_for_each_segment(spark, tmp_path):
    index = small_index(spark, tmp_path)
    q = spark.createDataFrame([(1, "heron1 badger"), (2, "kestrel20 otter")], "query_id long, query string")
    spark.sparkContext.setJobGroup("sequential", "")
    hits = [search.sequential_segments(index, q), search.sequential_segments(index, q, early=0.1)]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sequential")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs and all(h.count() for h in hits)


def test_a_round_of_refinement_searches_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def find(table, k):
        def run(rows):
            for pdf in rows:
                ran.add(len(pdf))
                yield pdf.assign(segment_id=0, chunk_idx=7, score=1.0)[["query_id", "segment_id", "chunk_idx", "score"]]

        return table.coalesce(1).mapInPandas(run, "query_id long, segment_id int, chunk_idx long, score double")

    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    replies = iter(["REFINE: c", "FOUND", "FOUND"])
    hits = search.refine_all(find, q, 8, lambda h: {r.query_id: ["x"] for r in h.collect()}, lambda question, shown: next(replies))
    assert hits.count() == 2 and ran.value == 3  # two queries, then one of them again


def test_the_index_moves_lists_and_search_counts_as_it_sums(spark, tmp_path):
    index = small_index(spark, tmp_path)
    assert index.lists.count() < index.doc_keywords.count() / 2
    q = spark.createDataFrame([(1, "heron1 badger"), (2, "kestrel20 otters of the badgers")], "query_id long, query string")
    terms = search.query_terms(q)
    first = search.bm25(index, terms)
    assert not search.rescore(index, terms, first).select("score")._jdf.queryExecution().optimizedPlan().toString().count("kw#")
    pick = lambda df: sorted(map(str, df.select("query_id", "segment_id", "chunk_idx", "score", "coverage", "exact").collect()))
    assert pick(search.rescore(index, terms, first)) == pick(search.rescore(index, terms, first.drop("covered", "exact")))
