"""The engine as one object over a folder: an index by segments, conversations, catalogs. Each method gives a DataFrame or a small dict.

Outside models are callables that the caller passes; without them, answers are the assembled context. Every change is an append or an overwrite of
one partition, so it is seen by the next call and survives a lost executor.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from . import constants as C
from . import hooks
from .functions import text as T
from .operators import catalog, context, conversation, search
from .operators import index as ix
from .sources import files
from .streaming import ingest

TURN = "chunk_id string, ts long, user_message string, system_response string, text string, source_refs array<struct<chunk_id:string,relevance_score:double,snippet:string>>"


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: configuration.Config | None = None, now: Callable[[], float] = time.time):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self.config = config or configuration.Config()
        self.asked: list[float] = []  # seconds that the searches of chats took
        self.admission = hooks.Admission(self.config.auth, self.config.rate_limit)
        self.reload_segments()

    # tables

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def reload_segments(self) -> ix.Index | None:
        """Takes up the segments that are there now."""
        path = f"{self.root}/index"
        if self._exists(f"{path}/segment_stats"):
            for t in ix.Index.STORED:
                self.spark.catalog.refreshByPath(f"{path}/{t}")
            self.index = ingest.read(self.spark, path)
        else:
            self.index = None
        return self.index

    def turns(self) -> DataFrame:
        path = f"{self.root}/conversations"
        if not self._exists(path):
            return self.spark.createDataFrame([], TURN)
        return self.spark.read.schema(TURN).parquet(path)

    def segments(self) -> list[int]:
        return [] if self.index is None else sorted(r.segment_id for r in self.index.segment_stats.select("segment_id").collect())

    def originals(self) -> DataFrame:
        path = f"{self.root}/originals.json"
        return files.originals(self.spark, path) if self._exists(path) else self.spark.createDataFrame([], files.ORIGINALS)

    reload_catalog = originals

    def guide(self) -> DataFrame:
        """One row: the guide's file, or its default shape where there is none, with the conversations as they are now."""
        path = f"{self.root}/guide.json"
        if self._exists(path):
            g = files.guide(self.spark, path)
        else:
            total = 0 if self.index is None else self.index.segment_stats.agg(F.sum("n")).first()[0] or 0
            g = self.spark.createDataFrame([(("3.0", "Loaded Corpus", "corpus", ([],), ([],), ([],), (total, {}), (0, [])))], files.CODE)
        turns = self.turns().withColumn("source_refs", F.transform("source_refs", lambda x: x["chunk_id"]))
        return g.drop("conversations").crossJoin(F.broadcast(conversation.rollup(turns)))  # a row each

    # additions

    def add_file(self, name: str, content: str) -> int:
        """Adds a document as the next segment; gives its number."""
        return self.add_files(self.spark.createDataFrame([(name, content)], "file string, text string"))

    def add_files(self, table: DataFrame) -> int:
        number = max(self.segments(), default=0) + 1
        ingest.ingest(table, f"{self.root}/index", number - 1)
        self.reload_segments()
        return number

    def add_file_path(self, path: str) -> int:
        with open(files.allowed(path), encoding="utf-8", errors="replace") as f:
            return self.add_file(path.rsplit("/", 1)[-1], f.read())

    def save_turn(self, question: str, answer: str, refs: Iterable[tuple[str, float, str]] = ()) -> str:
        number = conversation.max_number(self.turns()).first().max_number + 1
        row = (f"CH{number}", int(self.now()), question, answer, f"User: {question}\n\nAssistant: {answer}", list(refs))
        self.spark.createDataFrame([row], TURN).coalesce(1).write.mode("append").parquet(f"{self.root}/conversations")
        return row[0]

    def clear_database(self) -> None:
        """Removes all conversations."""
        self.spark.createDataFrame([], TURN).write.mode("overwrite").parquet(f"{self.root}/conversations")

    # search

    def _hits(self, query: str, k: int) -> DataFrame:
        """One segment: two phases and coherence; many: each for itself, then merged."""
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        if len(self.segments()) == 1:
            return search.source_coherence(search.two_phase(self.index, q, k, k1=self.config.search.bm25_k1, b=self.config.search.bm25_b), self.index.chunks)
        if self.config.segments.mode == "sequential":
            return search.sequential_segments(self.index, q, k, self.config.segments.early_stop_score)
        return search.multi_segment(self.index, q, k)

    def search(
        self, query: str, top_k: int | None = None, says_yes: Callable[[str, str], bool] | None = None, judge: search.Judge | None = None, max_refine: int = C.REFINE_ROUNDS
    ) -> DataFrame:
        """query_id, query, chunk_id, text, score, rank. With a judge, terms that it asks for are searched as well, in at most max_refine rounds; with
        says_yes, hits are scanned.
        """
        k = top_k or self.config.search.top_k
        if self.index is None:
            return self.spark.createDataFrame([], "query_id long, query string, chunk_id string, text string, score double, rank int")
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        wide = max(k, self.config.scanner.max_candidates) if says_yes else k

        def previews(hits: list) -> list[str]:
            keys = self.spark.createDataFrame([(r.segment_id, r.chunk_idx, r.rank) for r in hits], "segment_id int, chunk_idx long, rank int")
            found = self.index.chunks.select(*ix.KEY, F.substring("text", 1, C.JUDGE_CHARS).alias("text")).join(F.broadcast(keys), ix.KEY)  # k rows
            return [r.text for r in found.orderBy("rank").collect()]

        hits = search.refine(self._hits, query, wide, previews, judge, max(1, max_refine)) if judge else self._hits(query, wide)
        h = hits.join(self.index.chunks.select(*ix.KEY, "chunk_id", "text"), ix.KEY).join(q, "query_id")
        h = h.select("query_id", "query", "chunk_id", "text", "score", F.col("rank").cast("int").alias("rank"))
        return (context.scan(h, says_yes) if says_yes else h).where(F.col("rank") <= k)

    def search_conversations(self, query: str, k: int = 3) -> DataFrame:
        return conversation.search(self.turns(), self.spark.createDataFrame([(0, query)], "query_id long, query string"), F.lit(int(self.now())), k)

    def chat(self, question: str, ask: Callable[[str], str] | None = None, score: Callable[[list[str], list[str]], list[float]] | None = None, says_yes: Callable[[str, str], bool] | None = None, judge: search.Judge | None = None) -> dict:
        """Search (refined if there is a judge), threshold, rerank, context with neighbours, answer, and the turn saved with its references."""
        began = self.now()
        n = 0 if self.index is None else self.index.segment_stats.agg(F.sum("n")).first()[0] or 0
        k = next((top for least, top in reversed(C.TIERS) if n >= least), self.config.search.top_k) if n else self.config.search.top_k
        hits = context.rerank(search.score_threshold(self.search(question, k, says_yes, judge), self.config.search.score_threshold), score)
        rows = hits.orderBy("rank").collect()
        self.asked.append(self.now() - began)
        text = ""
        if rows:
            near = context.adjacent(self.index.chunks, hits.select("chunk_id"), self.config.search.context_window)
            around = near.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "near_text"))), lambda x: x["near_text"]), "\n").alias("text"))
            text = context.assemble(hits.select("query_id", "chunk_id", "rank"), around, self.config.search.max_context_chars).first().context
        answer = hooks.with_retry(ask, f"{text}\n\nQuestion: {question}", self.config.llm.max_retries, self.config.llm.retry_backoff_ms) if ask else text
        refs = [(r.chunk_id, float(r.score), r.text[: C.SNIPPET_BYTES]) for r in rows]
        turn = self.save_turn(question, answer, refs)
        return {"id": turn, "answer": answer, "sources": [r[0] for r in refs], "context": text}

    def chat_stream(self, question: str, ask: Callable[[str], Iterable[str]], k: int = C.TOP_K) -> Iterator[str]:
        """The events of a streamed answer. A question about the one who asks looks into conversations first."""
        hits = self.search(question, k).select("query_id", "chunk_id", "score", "rank")
        if self.spark.range(1).select(T.is_self_reference(F.lit(question))).first()[0]:
            hits = conversation.blend(self.search_conversations(question).select("query_id", "chunk_id", "score", "rank"), hits, k)
        rows = hits.orderBy("rank").collect()
        pieces: list[str] = []

        def heard() -> Iterator[str]:
            for p in ask(question):
                pieces.append(p)
                yield p

        yield from hooks.sse_events([{"chunk_id": r.chunk_id, "score": r.score} for r in rows], heard())
        self.save_turn(question, "".join(pieces), [(r.chunk_id, float(r.score), "") for r in rows])

    # lookups

    def chunk(self, chunk_id: str, context_window: int = 0) -> DataFrame:
        """The chunk, or with a window it and its neighbours in order."""
        ids = self.spark.createDataFrame([(chunk_id,)], "chunk_id string")
        found = context.chunk_by_id(self.index.chunks, ids)
        if not context_window:
            return found.select("chunk_id", "source_file", "text")
        return context.adjacent(self.index.chunks, found.select("chunk_id"), context_window).orderBy("distance")

    def reconstruct(self, chunk_ids: list[str] | None = None, text: str = "") -> DataFrame:
        ids = chunk_ids if chunk_ids is not None else self.extract_ids(text)
        return context.reconstruct(self.index.chunks, self.spark.createDataFrame([("0", ids)], "request_id string, chunk_ids array<string>"))

    def extract_ids(self, text: str) -> list[str]:
        return self.spark.range(1).select(T.chunk_ids(F.lit(text))).first()[0]

    def sources(self, turn: str) -> DataFrame:
        return self.turns().where(F.col("chunk_id") == turn).select(F.inline("source_refs"))

    def tell_me_more(self, turn: str, aspect: str, ask: Callable[[str], str] | None = None) -> dict:
        """Another question about what a turn drew on, without a search; saved as a turn of its own."""
        t = self.turns().where(F.col("chunk_id") == turn)
        refs = [tuple(r) for r in self.sources(turn).collect()]
        r = t.select("chunk_id", F.transform("source_refs", lambda x: x["chunk_id"]).alias("source_refs"))
        found = conversation.follow_up(r, self.index.chunks).first()
        text = found.context if found else ""
        answer = hooks.with_retry(ask, f"{text}\n\nQuestion: {aspect}") if ask else text
        return {"id": self.save_turn(aspect, answer, refs), "answer": answer, "context": text}

    def catalog(self, type: str | None = None, source: str | None = None, page: int = 0, page_size: int = C.PAGE_SIZE) -> DataFrame:
        return catalog.page(self.index.chunks, page, page_size, type, source)

    def catalog_counts(self) -> tuple[DataFrame, DataFrame]:
        return catalog.types(self.index.chunks.select("chunk_id").unionByName(self.turns().select("chunk_id"))), catalog.by_source(self.index.chunks)

    def stats(self) -> DataFrame:
        return catalog.stats(self.index.chunks, self.index.doc_stats)

    def query_averages(self) -> dict:
        """How many questions this engine was asked, and the mean seconds of their searches."""
        return {"queries": len(self.asked), "mean_seconds": sum(self.asked) / len(self.asked) if self.asked else 0.0}

    def original(self, file_id: str) -> DataFrame:
        """stored_path and MIME type of an original."""
        return self.originals().where(F.col("file_id") == file_id).select("file_id", "stored_path", catalog.mime(F.col("format")).alias("mime"))

    def code_discussions(self, chunk_id: str) -> DataFrame:
        return conversation.discussions(self.turns().withColumn("source_refs", F.transform("source_refs", lambda x: x["chunk_id"])), chunk_id)

    def fixes(self, name: str) -> DataFrame:
        g = self.guide()
        return catalog.fixes_for_file(g.select(F.inline("code_files.files")), g.select(F.inline("fixes.entries")), name)

    def feature(self, text: str) -> DataFrame:
        return catalog.feature(self.guide().select(F.inline("features.entries")), text)

    def admit(self, client: str, path: str, key: str = "") -> int:
        """The status of a request: 200, 401 without the right key, or 429 beyond the client's rate. /health is always admitted."""
        return self.admission.admit(client, path, key, self.now())

    def health(self) -> dict:
        return {"status": "ok", "segments": self.segments()}
