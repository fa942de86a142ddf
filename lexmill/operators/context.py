"""Around the hits: neighbours, texts in rank order, lookups, reconstruction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def adjacent(chunk_table: DataFrame, ids: DataFrame, window: int = C.CONTEXT_WINDOW) -> DataFrame:
    """chunk_id, near_id, distance: chunks of the same file within `window` (3 at most) places, in order; an equi-join for each place."""
    w = min(window, C.CONTEXT_WINDOW_MOST)
    at = ids.select("chunk_id").distinct().join(chunk_table.select("chunk_id", "source_file", "n"), "chunk_id")
    wanted = at.select("chunk_id", "source_file", F.explode(F.array(*[F.lit(d) for d in range(-w, w + 1)])).alias("distance"), "n")
    wanted = wanted.select("chunk_id", "source_file", (F.col("n") + F.col("distance")).alias("n"), "distance")
    near = chunk_table.select("source_file", "n", F.col("chunk_id").alias("near_id"), F.col("text").alias("near_text"))
    return wanted.join(near, ["source_file", "n"]).select("chunk_id", "near_id", "distance", "near_text")


def containing(chunk_table: DataFrame, needles: DataFrame) -> DataFrame:
    """query_id, chunk_idx of the chunks whose text, in lower case, contains the needle (query_id, needle).

    A word inside a needle is a whole word of each text that contains it, so its longest one joins them; only needles without an inner word
    are held against all chunks.
    """
    cut = r"[^a-z0-9]+"
    words = F.filter(F.split("needle", cut), lambda w: w != "")
    edge = lambda side: F.regexp_like(side, F.lit("[a-z0-9]")).cast("int")
    inner = F.slice(words, F.lit(1) + edge(F.substring("needle", 1, 1)), F.greatest(F.size(words) - edge(F.substring("needle", 1, 1)) - edge(F.substring("needle", -1, 1)), F.lit(0)))
    longest = F.aggregate(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    n = needles.select("query_id", "needle", longest.alias("word"))
    c = chunk_table.select("chunk_idx", F.lower("text").alias("hay"))
    pairs = c.select("chunk_idx", F.explode(F.array_distinct(F.split("hay", cut))).alias("word")).join(n.where("word != ''"), "word")
    by_word = pairs.join(c, "chunk_idx").where(F.contains("hay", "needle"))
    short = c.join(n.where("word = ''"), F.contains("hay", "needle"))
    return by_word.select("query_id", "chunk_idx").unionByName(short.select("query_id", "chunk_idx"))


def assemble(hits: DataFrame, texts: DataFrame, limit: int = C.CONTEXT_CHARS) -> DataFrame:
    """query_id, context: the hits' texts in rank order, conversations marked, divided by rules, cut at the limit."""
    t = hits.join(texts.select("chunk_id", "text"), "chunk_id")
    part = F.when(F.col("chunk_id").startswith("CH"), F.concat(F.lit("[Previous conversation]\n"), F.col("text"))).otherwise(F.col("text"))
    c = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return c.select("query_id", T.truncate_context(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n---\n\n"), limit).alias("context"))


def chunk_by_id(chunk_table: DataFrame, ids: DataFrame, last: bool = False) -> DataFrame:
    """The chunk of each id: the first that has it, or the last."""
    order = Window.partitionBy("chunk_id").orderBy(F.desc("chunk_idx") if last else F.asc("chunk_idx"))
    found = chunk_table.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return found.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def reconstruct(chunk_table: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, content ([id], line break, text; in the order asked for), ratio; ids that don't exist are left out."""
    asked = requests.select("request_id", "chunk_ids", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    first = chunk_by_id(chunk_table, asked.select("chunk_id"))
    found = asked.join(first.select("chunk_id", "text"), "chunk_id")
    block = F.concat(F.lit("["), F.col("chunk_id"), F.lit("]\n"), F.col("text"))
    c = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("b"))
    content = F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit(""))
    r = requests.join(c, "request_id", "left").select("request_id", "chunk_ids", content.alias("content"))
    return r.select("request_id", "content", T.compression_ratio(F.col("chunk_ids"), F.col("content")).alias("ratio"))


def rerank(hits: DataFrame, score: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by an outside scorer of (queries, beginnings of texts); without one, or where it fails, as they are."""
    if score is None:
        return hits

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            try:
                pdf["score"] = [float(x) for x in score(list(pdf["query"]), [t[: C.RERANK_CHARS] for t in pdf["text"]])]
            except Exception:  # noqa: BLE001 - the scorer is the caller's
                pass
            yield pdf

    out = hits.mapInPandas(run, hits.schema)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")).cast("int"))


def scan(hits: DataFrame, says_yes: Callable[[str, str], bool]) -> DataFrame:
    """Of the first 64 hits those whose text the scanner says yes to, 8 at most; if none, the first 8."""
    h = hits.where(F.col("rank") <= C.SCANNER_CANDIDATES)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["yes"] = [bool(says_yes(q, t[: C.SCANNER_CHARS])) for q, t in zip(pdf["query"], pdf["text"])]
            yield pdf

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema)
    s = h.mapInPandas(run, f"{fields}, yes boolean")
    by = Window.partitionBy("query_id")
    s = s.withColumn("any", F.max(F.col("yes").cast("int")).over(by)).where(F.col("yes") | (F.col("any") == 0))
    s = s.withColumn("rank", F.row_number().over(by.orderBy("rank")).cast("int"))
    return s.where(F.col("rank") <= C.SCANNER_KEEP).drop("yes", "any")
