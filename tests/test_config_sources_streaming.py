import json

import pytest
from pyspark.sql import functions as F

from lexmill import config, hooks
from lexmill.operators import catalog, conversation, search
from lexmill.operators import chunking
from lexmill.operators import index as ix
from lexmill.sources import files, sinks
from lexmill.streaming import ingest, limiter


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"server": {"port": 9}, "search": {"top_k": 3, "bm25_k1": 2, "unknown": 1}, "reranker": {"enabled": "no", "candidate_count": 7}, "scanner": 5}))
    c = config.load(str(p))
    assert (c.server.port, c.server.host, c.search.top_k, c.search.bm25_k1, c.search.bm25_b) == (9, "0.0.0.0", 3, 2.0, 0.75)
    assert c.reranker.enabled is False and c.reranker.candidate_count == 7 and c.scanner.max_keep == 8 and c.judge.enabled
    for text in ("", "{", "[]"):
        p.write_text(text)
        assert config.load(str(p)) == config.Config()
    assert config.load(str(tmp_path / "none")) == config.load(None) == config.Config()
    monkeypatch.setenv("LEXMILL_MODEL", "m")
    assert config.load(None).llm.external_model == "m"


def test_text_files_become_chunks_and_a_manifest(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("alpha beta beta\n\ngamma café")
    (tmp_path / "in" / "deep" / "b.md").write_bytes(b"delta \xff epsilon")
    (tmp_path / "in" / "c.pdf").write_text("no")
    f = files.text_files(spark, str(tmp_path / "in"))
    c = chunking.chunks(chunking.paragraphs(f))
    assert c.count() == 2
    out = str(tmp_path / "manifest.jsonl")
    sinks.write_manifest(c, ix.chunk_keywords(c), out)
    (tmp_path / "manifest.jsonl" / "part-bad.json").write_text('{"chunk_id": "x"}\nnot json\n')
    m = {r.chunk_id: r for r in files.manifest(spark, out).collect()}
    a = next(r for r in m.values() if r.keywords and "beta" in r.keywords)
    assert a.keywords[0] == "beta" and a.tf == {"beta": 2} and m["x"].token_end == 0 and m["x"].keywords == []
    sinks.convert_manifest(files.manifest(spark, out), files.derived_path(out))
    assert files.derived_is_current(files.derived_path(out), str(tmp_path / "gone")) and not files.derived_is_current(str(tmp_path / "gone"), out)
    with pytest.raises(PermissionError):
        files.allowed("/etc/passwd")
    with pytest.raises(PermissionError):
        files.allowed("/tmp/../etc/passwd")


def test_catalogs(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps([{"file_id": "1", "original_name": "A.pdf", "format": "pdf", "chunk_ids": ["c1", "c2"]}]))
    ids = spark.createDataFrame([("c1",), ("c9",)], "chunk_id string")
    got = catalog.originals_of(ids, files.originals(spark, str(p))).withColumn("mime", catalog.mime(F.col("format"))).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.original_name, r.mime) for r in got] == [("c1", "A.pdf", "application/pdf"), ("c9", None, "application/octet-stream")]
    (tmp_path / "meta.json").write_text(json.dumps({"segments": [{"id": 0, "dir": "s0"}, {"id": 1, "dir": "s1"}]}))
    reg = files.registry(spark, str(tmp_path / "meta.json"))
    assert catalog.unloaded(reg, reg.where("segment_id = 0")).collect()[0].dir == "s1"
    t = spark.createDataFrame([("CH1", 5), ("CH12x", 6), ("CH7", 7), ("doc", 8)], "chunk_id string, ts long")
    assert conversation.max_number(t).first().max_number == 7 and conversation.without_conversations(t).count() == 1
    lru = conversation.lru(spark.createDataFrame([(k, k % 30) for k in range(100)], "key int, at int"), 3).orderBy("rank").collect()
    assert [(r.key, r.last_access) for r in lru] == [(29, 29), (59, 29), (89, 29)]


def test_files_that_arrive_are_searchable(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "one.txt").write_text("kestrel hovering over meadow\n\n" * 3)
    ingest.stream(spark, src, out, state).awaitTermination(120)
    (tmp_path / "src" / "two.txt").write_text("walrus sleeping on ice")
    ingest.stream(spark, src, out, state).awaitTermination(120)
    q = spark.createDataFrame([(1, "sleeping walruses"), (2, "kestrels")], "query_id long, query string")
    index = ingest.read(spark, out)
    hits = search.multi_segment(index, q).join(index.chunks.select("segment_id", "chunk_idx", "text"), ["segment_id", "chunk_idx"]).collect()
    assert {(r.query_id, r.text.split()[0]) for r in hits} == {(1, "walrus"), (2, "kestrel")}
    before = index.chunks.count()
    ingest.ingest(spark.createDataFrame([("x/two.txt", "walrus sleeping on ice")], "file string, text string"), out, 1)  # a batch that runs again
    assert ingest.read(spark, out).chunks.count() == before


def test_token_bucket_in_batches_and_as_a_stream(spark, tmp_path):
    rows = [(1, i, float(i)) for i in range(10)] + [(2, 100, 0.0), (2, 101, 0.0), (2, 102, 0.0), (2, 103, 31.0), (3, 200, None or 5.0)]
    e = spark.createDataFrame(rows, "key long, event_id long, at double")
    got = {r.event_id: r.allowed for r in limiter.limit(e, 2).collect()}
    assert [got[i] for i in (100, 101, 102, 103, 200)] == [True, True, False, True, True] and sum(got[i] for i in range(10)) == 2
    for n, part in enumerate((rows[:5] + rows[10:12], rows[5:10] + rows[12:])):
        spark.createDataFrame(part, "key long, event_id long, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key long, event_id long, at double").parquet(str(tmp_path / "in"))
        q = limiter.limit_stream(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == got


def test_hooks():
    lines = [b'data: {"choices":[{"delta":{"content":"a"}}]}\nda', b'ta: {"choices":[{"delta":{}}]}\ndata: oops\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"c"}}]}\n']
    assert list(hooks.sse_tokens(lines)) == ["a", "b"]
    waits, answers = [], iter(["ERROR: timeout", "ERROR: 503", "fine"])
    assert hooks.with_retry(lambda p: next(answers), "p", sleep=waits.append) == "fine" and waits == [1.0, 2.0]
    assert hooks.with_retry(lambda p: "ERROR: bad key", "p", sleep=waits.append) == "ERROR: bad key" and len(waits) == 2
    assert hooks.fan_out(lambda p: p.upper() if p != "x" else 1 / 0, ["a", "x", "b"]) == ["A", "", "B"]
    assert len(list(hooks.sse_events([], ["a", "b"]))) == 4 and hooks.judge_or_found(lambda p: 1 / 0, "p") == "FOUND"
