"""Conversations as chunks: turns, search with decay, blending, references and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def turns(messages: DataFrame, epoch: int = 1_700_000_000, step: int = 3600) -> DataFrame:
    """Pairs of a user's message and the answer after it: conv_id, turn, chunk_id (CH and a number), ts, text, user_message, system_response.

    Messages have no time of their own here, so the n-th turn of all gets epoch + n * step. Turns without an answer have an empty one.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("")
    m = m.select("conv_id", "turn", F.col("text").alias("user_message"), answer.alias("system_response"))
    m = m.withColumn("block", F.shiftright("conv_id", 16))  # numbers run on over blocks of conversations, so only a row for each block is ordered in one task
    n = m.groupBy("block").agg(F.count("*").alias("k"))
    n = n.select("block", F.coalesce(F.sum("k").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    m = m.join(n, "block").withColumn("number", F.col("first") + F.row_number().over(Window.partitionBy("block").orderBy("conv_id", "turn")))
    return m.select("conv_id", "turn", F.concat(F.lit("CH"), F.col("number").cast("string")).alias("chunk_id"), (F.lit(epoch) + F.col("number") * step).alias("ts"), F.concat(F.lit("User: "), "user_message", F.lit("\n\nAssistant: "), "system_response").alias("text"), "user_message", "system_response")


def keywords(turn_table: DataFrame) -> DataFrame:
    """chunk_id, keyword, tf, rank: the 20 commonest words of both sides of a turn."""
    words = F.concat(T.chat_words(F.col("user_message")), T.chat_words(F.col("system_response")))
    k = turn_table.select("chunk_id", F.explode(words).alias("keyword")).groupBy("chunk_id", "keyword").agg(F.count("*").alias("tf"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("tf"), "keyword"))).where(F.col("rank") <= C.CHAT_KEYWORDS)


def search(turn_table: DataFrame, queries: DataFrame, now: Column, k: int = 3) -> DataFrame:
    """query_id, chunk_id, score, rank: turns one of whose keywords is in the query or contains it.

    Containment either way is no equality, so this is a nested loop over (distinct keyword, query); turns are joined to what matched by their keywords.
    """
    kw = keywords(turn_table)
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q != ''")
    words = kw.select("keyword").distinct()
    match = words.crossJoin(q).where(F.instr(F.col("q"), F.col("keyword")).cast("boolean") | F.instr(F.col("keyword"), F.col("q")).cast("boolean")).select("query_id", "keyword")
    hits = kw.select("chunk_id", "keyword").join(match, "keyword").select("query_id", "chunk_id").distinct().join(turn_table.select("chunk_id", "ts"), "chunk_id")
    hits = hits.select("query_id", "chunk_id", F.round(F.lit(C.CONVERSATION_SCORE) + T.decay(F.col("ts"), now), 6).alias("score"))
    number = F.substring("chunk_id", 3, 20).cast("int")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), number))).where(F.col("rank") <= k)


def blend(conversation_hits: DataFrame, doc_hits: DataFrame, k: int) -> DataFrame:
    """Three conversation hits first, then hits on documents until there are k; lists keep their own order."""
    a = conversation_hits.where(F.col("rank") <= 3).select("query_id", "chunk_id", "score", "rank", F.lit(0).alias("part"))
    b = doc_hits.where(~F.col("chunk_id").startswith("CH")).where(F.col("rank") <= max(k - 3, 5)).select("query_id", "chunk_id", "score", "rank", F.lit(1).alias("part"))
    u = a.unionByName(b).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank")))
    return u.where(F.col("rank") <= k).drop("part")


def max_number(ids: DataFrame) -> DataFrame:
    """The greatest number behind CH; other ids are skipped."""
    return ids.where(F.col("chunk_id").startswith("CH")).agg(F.coalesce(F.max(F.expr("try_cast(substring(chunk_id, 3) AS INT)")), F.lit(0)).alias("max_number"))


def sources(turn_refs: DataFrame) -> DataFrame:
    """chunk_id, pos, ref: the references of each turn, in order."""
    return turn_refs.select("chunk_id", F.posexplode("source_refs").alias("pos", "ref"))


def discussions(turn_refs: DataFrame, chunk_id: str) -> DataFrame:
    """The turns that refer to a chunk."""
    return turn_refs.where(F.array_contains("source_refs", chunk_id))


def follow_up(turn_refs: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """chunk_id, context: the texts a turn drew on, for another question about them, without a search."""
    s = sources(turn_refs).join(chunk_table.select(F.col("chunk_id").alias("ref"), "text"), "ref")
    c = s.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return c.select("chunk_id", T.truncate_context(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n---\n\n")).alias("context"))


def latest(turn_table: DataFrame, n: int = C.GUIDE_SUMMARIES) -> DataFrame:
    """The n turns that came last; a top-k, not a sort."""
    return turn_table.orderBy(F.desc("ts")).limit(n)


def rollup(turn_table: DataFrame, n: int = C.GUIDE_SUMMARIES) -> DataFrame:
    """One row, conversations: how many turns there are, and of the last n their id, the beginning of the question and the references, oldest first."""
    last = latest(turn_table, n).select("ts", F.struct("chunk_id", F.substring("user_message", 1, 100).alias("summary"), F.coalesce("source_refs", F.array().cast("array<string>")).alias("source_refs")).alias("entry"))
    entries = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "entry"))), lambda x: x["entry"]).alias("summaries"))
    return turn_table.agg(F.count("*").alias("count")).crossJoin(entries).select(F.struct("count", "summaries").alias("conversations"))


def without_conversations(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.where(~F.col("chunk_id").startswith("CH"))


def lru(accesses: DataFrame, n: int = C.LRU_TURNS) -> DataFrame:
    """The n keys accessed last: key, last_access, rank."""
    last = accesses.groupBy("key").agg(F.max("at").alias("last_access"))
    return last.orderBy(F.desc("last_access"), "key").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last_access"), "key")))
