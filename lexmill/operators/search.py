"""Batched two-phase BM25 over an Index. A query table (query_id, query) is answered in one job.

Phase one: the queries' distinct stems meet the posting lists, so that a row is looked up for many postings; the postings found are brought together
by chunk, and only there, in the task that adds them up, are they multiplied by the queries that ask for them. The same sum counts what phase two needs:
how many of a query's stems the chunk has, and how many of its words as they are. A window keeps the best of each query. Ties: score descending, then
segment_id, chunk_idx. Scores are rounded to 9 digits before ranks are taken, so that they do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.porter import stem_column
from ..sources.scratch import shared_folder, tidy
from .index import KEY, Index, by_chunk, is_bigram

HIT = ["query_id", "segment_id", "chunk_idx"]


def query_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """query_id, term, stem: each distinct keyword of each query. Queries of stop words only have none and find nothing."""
    t = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    return t.withColumn("stem", stem_column("term") if stemmed else F.col("term"))


def idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log((F.greatest(n - df, F.lit(0.0)) + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl.cast("double") / avgdl))


def _summed(found: DataFrame, terms: DataFrame) -> DataFrame:
    """HIT, score, covered, exact of found postings (KEY, stem, keyword, first, w), w being what one adds to a score.

    Postings of a chunk are in one task before they are joined to the queries, so that sums of queries aren't moved. A stem counts once, where it is first.
    """
    q = terms.groupBy("query_id", "stem").agg(F.collect_set("term").alias("terms"))
    hits = found.join(q, "stem")
    return hits.groupBy(*HIT).agg(F.round(F.sum(F.when(F.col("first"), F.col("w"))), 9).alias("score"), F.count(F.when(F.col("first"), 1)).alias("covered"), F.count(F.when(F.array_contains("terms", F.col("keyword")), 1)).alias("exact")).where("covered > 0")


def bm25(index: Index, terms: DataFrame, k1: float = C.K1, b: float = C.B) -> DataFrame:
    """query_id, segment_id, chunk_idx, score with tf 1: df and averages are those of the segment. covered and exact: for the second phase."""
    stems = terms.select("stem").distinct()
    df = index.stem_stats.join(stems, "stem", "left_semi")
    segments = F.broadcast(index.segment_stats)  # a row for each segment
    if index.has("lists"):
        words = index.lists.where(~is_bigram(F.col("keyword"))).select("segment_id", "stem", "keyword", "first", "chunks")
        more = index.added.select("segment_id", "stem", "keyword", "first", F.array("chunk_idx").alias("chunks"))
        found = words.join(stems, "stem", "left_semi").unionByName(more.join(stems, "stem", "left_semi")).join(df, ["segment_id", "stem"]).join(segments, "segment_id")
        found = found.select("segment_id", "stem", "keyword", "first", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"), F.explode("chunks").alias("chunk_idx"))
    else:
        found = index.postings.join(stems, "stem", "left_semi").join(df, ["segment_id", "stem"]).join(segments, "segment_id")
        found = found.select("segment_id", "stem", F.lit(None).cast("string").alias("keyword"), F.lit(True).alias("first"), "avgdl", idf(F.col("n"), F.col("df")).alias("idf"), "chunk_idx")
    score = F.col("idf") * saturation(F.lit(1.0), F.col("dl"), F.col("avgdl"), k1, b)
    found = by_chunk(found).join(index.doc_stats, KEY).select(*KEY, "stem", "keyword", "first", score.alias("w"))
    summed = _summed(found, terms)
    return summed if index.has("lists") else summed.drop("covered", "exact")


def bm25_tf(index: Index, terms: DataFrame, k1: float = C.K1, b: float = C.B, cap: int = C.KEYWORD_CAP) -> DataFrame:
    """The other scoring: stored tf, df summed over a stem's keywords, the first 200 keywords of a chunk, average length in tokens."""
    dk = index.doc_keywords.where((F.col("pos") <= cap) & (F.col("origin") == "own"))
    found = dk.join(terms.select("stem").distinct(), "stem", "left_semi").select(*KEY, "stem", "tf")
    df = found.groupBy("segment_id", "stem").agg(F.count("*").alias("df"))
    dl = dk.groupBy(*KEY).agg(F.count("*").alias("dl"))
    seg = index.chunks.groupBy("segment_id").agg(F.count("*").alias("n"), F.avg(F.col("token_end") - F.col("token_start")).alias("avgdl"))
    found = by_chunk(found.join(df, ["segment_id", "stem"])).join(dl, KEY).join(F.broadcast(seg), "segment_id")
    score = idf(F.col("n"), F.col("df")) * saturation(F.col("tf").cast("double"), F.col("dl"), F.col("avgdl"), k1, b)
    found = found.select(*KEY, "stem", F.lit(None).cast("string").alias("keyword"), F.lit(True).alias("first"), score.alias("w"))
    return _summed(found, terms).drop("covered", "exact")


def ranked(hits: DataFrame, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), "segment_id", "chunk_idx")
    return hits.withColumn(name, F.row_number().over(order))


def top_k(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    return ranked(hits, by).where(F.col("rank") <= k)


def rescore(index: Index, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """score * (1 + 0.8 coverage^2) * (1 + min(0.25 exact, 0.75)); first_score is what it was.

    coverage: share of the query's distinct stems among the chunk's; exact: how many of its words the chunk has as they are. Both are counted with the
    score; only candidates that come without are held against the chunks' keywords.
    """
    size = terms.groupBy("query_id").agg(F.countDistinct("stem").alias("n_stems"))
    c = candidates
    if "covered" not in c.columns:
        of = candidates.select(*HIT).join(terms, "query_id")
        known = index.doc_keywords.select(*KEY, "stem", "keyword").join(terms.select("stem").distinct(), "stem", "left_semi")
        found = of.join(known, [*KEY, "stem"]).groupBy(*HIT).agg(F.countDistinct("stem").alias("covered"), F.count(F.when(F.col("keyword") == F.col("term"), 1)).alias("exact"))
        c = candidates.join(found, HIT, "left")
    c = c.join(size, "query_id")
    coverage = F.coalesce("covered", F.lit(0)).cast("double") / F.col("n_stems")
    exact = F.coalesce("exact", F.lit(0))
    boost = (1.0 + C.COVERAGE_WEIGHT * coverage * coverage) * (1.0 + F.least(exact * C.EXACT_STEP, F.lit(C.EXACT_MOST)))
    more = [x for x in candidates.columns if x not in (*HIT, "score", "covered", "exact")]
    return c.select(*HIT, F.round(F.col("score") * boost, 9).alias("score"), coverage.alias("coverage"), exact.cast("long").alias("exact"), F.col("score").alias("first_score"), *more)


def two_phase(index: Index, queries: DataFrame, k: int = C.TOP_K, **bm: float) -> DataFrame:
    """query_id, segment_id, chunk_idx, score, rank: the best k of max(32 k, 256) candidates; k and fewer candidates keep their first score."""
    terms = query_terms(queries)
    first = ranked(bm25(index, terms, **bm)).where(F.col("rank") <= max(C.OVERSAMPLE * k, C.OVERSAMPLE_LEAST)).drop("rank")
    first = first.withColumn("n_candidates", F.count("*").over(Window.partitionBy("query_id")))
    second = rescore(index, terms, first)
    hits = second.select(*HIT, F.when(F.col("n_candidates") <= k, F.col("first_score")).otherwise(F.col("score")).alias("score"))
    return top_k(hits, k)


def _by_segment(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The best max(k, 8) of each segment with its own statistics, rescored."""
    terms = query_terms(queries)
    first = top_k(bm25(index, terms), max(k, C.SEGMENT_LEAST), ["query_id", "segment_id"])
    return rescore(index, terms, first).select(*HIT, "score")


def multi_segment(index: Index, queries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Best max(k, 8) of each segment with its own statistics, all rescored, the best k of all."""
    return top_k(_by_segment(index, queries, k), k)


def sequential_segments(index: Index, queries: DataFrame, k: int = C.TOP_K, early: float = 0.0) -> DataFrame:
    """One segment after the other; a query that has a hit of `early` or more asks no other segment (0: never).

    Segments have their own statistics, so that one job gives what each would have found in its turn; hits of segments after a query's last are dropped.
    """
    hits = top_k(_by_segment(index, queries, k), k, ["query_id", "segment_id"]).drop("rank")
    if early > 0:
        last = hits.where(F.col("score") >= early).groupBy("query_id").agg(F.min("segment_id").alias("last"))
        hits = hits.join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("segment_id") <= F.col("last"))).drop("last")
    return top_k(hits, k)


def source_coherence(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits of a query from the same file: score * (1 + min(0.05 (n - 1), 0.30)); no file name, no boost."""
    h = hits.join(sources.select(*KEY, "source_file"), KEY, "left")
    n = F.count("*").over(Window.partitionBy("query_id", "source_file"))
    named = F.col("source_file").isNotNull() & (F.col("source_file") != "")
    boost = F.when(named, 1.0 + F.least((n - 1) * C.COHERENCE_STEP, F.lit(C.COHERENCE_MOST))).otherwise(1.0)
    return ranked(h.withColumn("score", F.round(F.col("score") * boost, 9)).select(*HIT, "source_file", "score"))


def score_threshold(hits: DataFrame, share: float = C.SCORE_THRESHOLD) -> DataFrame:
    """Hits of at least `share` of the score of their query's first hit."""
    first = F.max_by("score", -F.col("rank")).over(Window.partitionBy("query_id"))
    return hits.withColumn("first_score", first).where(F.col("score") >= F.col("first_score") * share).drop("first_score")


def dynamic_top_k(n_chunks: Column, default: int = C.TOP_K) -> Column:
    out = F.when(n_chunks == 0, default)
    for least, k in reversed(C.TIERS):
        out = out.when(n_chunks >= least, k)
    return out


def merged(*rounds: DataFrame) -> DataFrame:
    """Hits of several searches, each with its best score."""
    all_hits = rounds[0].select(*HIT, "score")
    for r in rounds[1:]:
        all_hits = all_hits.unionByName(r.select(*HIT, "score"))
    return ranked(all_hits.groupBy(*HIT).agg(F.max("score").alias("score")))


def conversation_boost(hits: DataFrame) -> DataFrame:
    """Hits on conversations count half as much again."""
    return ranked(hits.withColumn("score", F.when(F.col("chunk_id").startswith("CH"), F.col("score") * C.CONVERSATION_BOOST).otherwise(F.col("score"))))


Judge = Callable[[str, list[str]], str]


def refine(search: Callable[[str, int], DataFrame], query: str, k: int, previews: Callable[[list], list[str]], judge: Judge, rounds: int = C.REFINE_ROUNDS) -> DataFrame:
    """Search, let the judge see the best hits' beginnings, search again with its terms; hits keep their best score. A judge that fails is content."""
    hits, text = None, query
    for _ in range(rounds):
        found = search(text, k)
        hits = merged(hits, found) if hits is not None else merged(found)
        best = hits.where(F.col("rank") <= k)
        try:
            reply = judge(query, previews(best.orderBy("rank").collect()))
        except Exception:  # noqa: BLE001 - the judge is the caller's
            reply = "FOUND"
        if "FOUND" in reply or "REFINE:" not in reply:
            break
        text = reply.split("REFINE:", 1)[1].strip() or f"{query} {query}"
    return hits.where(F.col("rank") <= k)


def refine_all(search: Callable[[DataFrame, int], DataFrame], queries: DataFrame, k: int, previews: Callable[[DataFrame], dict[int, list[str]]], judge: Judge, rounds: int = C.REFINE_ROUNDS) -> DataFrame:
    """refine() for each query of a table: a round searches at once for all queries whose judge isn't content yet."""
    spark = queries.sparkSession
    asked = {r.query_id: r.query for r in queries.select(F.col("query_id").cast("long").alias("query_id"), "query").collect()}
    hits, texts, path = None, dict(asked), shared_folder(spark, "rounds")
    for n in range(rounds):
        table = spark.createDataFrame(list(texts.items()), "query_id long, query string")
        found = search(table, k).select(*HIT, "score")
        with tidy(spark):
            found.write.parquet(f"{path}/{n}")  # k rows a query: what comes after doesn't search again
        found = spark.read.schema(found.schema).parquet(f"{path}/{n}")
        hits = merged(hits, found) if hits is not None else merged(found)
        shown = previews(hits.where(F.col("rank") <= k).join(table.select("query_id"), "query_id", "left_semi"))
        following = {}
        for i in texts:
            try:
                reply = judge(asked[i], shown.get(i, []))
            except Exception:  # noqa: BLE001 - the judge is the caller's
                reply = "FOUND"
            if "FOUND" not in reply and "REFINE:" in reply:
                following[i] = reply.split("REFINE:", 1)[1].strip() or f"{asked[i]} {asked[i]}"
        texts = following
        if not texts:
            break
    return hits.where(F.col("rank") <= k)
