import json

import pytest

from lexmill.api import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    (root / "originals.json").write_text(json.dumps([{"file_id": "f1", "original_name": "B.txt", "stored_path": "x/b.txt", "format": "txt", "chunk_ids": ["b_DOC_0_1"]}]))
    (root / "guide.json").write_text(json.dumps({"code_files": {"files": [{"filename": "main.py", "chunk_ids": ["c1"]}]}, "fixes": {"entries": [{"fix_id": "fix1", "affected_code_chunks": ["c1"]}]}, "features": {"entries": [{"feature_id": "login_form"}]}}))
    e = Engine(spark, str(root), now=lambda: 1_700_000_000)
    assert e.search("anything").count() == 0 and e.health()["segments"] == []
    paragraph = "kestrels hover above the meadow looking for voles. " * 60
    e.add_file("birds.md", "\n\n".join(f"{paragraph} part{i}" for i in range(4)))
    return e


def test_search_chat_and_follow_up(engine):
    rows = engine.search("hovering kestrel part2", 3).orderBy("rank").collect()
    assert any("part2" in r.text for r in rows)  # its rare word is in its neighbours as well
    asked = []
    reply = engine.chat("where do kestrels hover", ask=lambda p: asked.append(p) or "above meadows")
    assert reply["answer"] == "above meadows" and reply["sources"] and "kestrels" in asked[0]
    assert {r.chunk_id for r in engine.sources(reply["id"]).collect()} == set(reply["sources"])
    more = engine.tell_me_more(reply["id"], "and voles?", ask=lambda p: "they hide")
    assert more["answer"] == "they hide" and "kestrels" in more["context"]
    assert engine.code_discussions(reply["sources"][0]).count() == 2
    events = list(engine.chat_stream("what did I say about kestrels, my friend", lambda q: ["you ", "asked"]))
    assert '"answer": "you asked"' in events[-1] and "CH" in events[0]
    engine.clear_database()
    assert engine.turns().count() == 0


def test_lookups(engine):
    first = engine.catalog(page_size=1).first()
    assert engine.chunk(first.chunk_id).count() == 1 and engine.chunk(first.chunk_id, 1).count() == 2 and engine.chunk("none").count() == 0
    assert engine.reconstruct(text=f"see {first.chunk_id} and x_DOC_9").first().content.startswith(f"[{first.chunk_id}]\n")
    types, sources = engine.catalog_counts()
    assert {r.type: r.n for r in types.collect()}["DOC"] == sources.first().n == engine.stats().first().n_chunks
    assert engine.original("f1").first().mime == "text/plain" and engine.fixes("main").first().fix_id == "fix1" and engine.feature("login").count() == 1
    with pytest.raises(PermissionError):
        engine.add_file_path("/etc/hostname")


def test_refined_search_admission_and_guide(spark, tmp_path):
    from lexmill import config

    now = [1_700_000_000.0]
    options = config.Config(auth=config.Auth(True, "secret"), rate_limit=config.RateLimit(True, 2))
    e = Engine(spark, str(tmp_path), options, now=lambda: now[0])
    assert e.admit("a", "/health") == 200 and e.admit("a", "/search") == 401 and e.admit("a", "/search", "Bearer wrong") == 401
    assert [e.admit("a", "/search", "Bearer secret") for _ in range(3)] == [200, 200, 429] and e.admit("b", "/search", "secret") == 200
    now[0] += 30
    assert e.admit("a", "/search", "secret") == 200 and e.admit("a", "/health") == 200
    g = e.guide().first()
    assert (g.version, g.chunks.total, g.conversations["count"]) == ("3.0", 0, 0) and e.fixes("x").count() == 0 and e.feature("x").count() == 0
    e.add_file("a.md", "kestrels hover over meadows. " * 20 + "\n\n" + "otters swim in rivers. " * 300)
    seen = []

    def judge(question, previews):
        seen.append(previews)
        return "REFINE: otters rivers" if len(seen) == 1 else "FOUND"

    plain = {r.chunk_id for r in e.search("kestrels hover", 5).collect()}
    refined = {r.chunk_id for r in e.search("kestrels hover", 5, judge=judge, max_refine=2).collect()}
    assert len(seen) == 2 and seen[0] and plain <= refined
    assert e.chat("where are otters", judge=lambda q, p: "FOUND")["sources"] and e.query_averages()["queries"] == 1
    rolled = e.guide().first()
    assert rolled.conversations["count"] == 1 and rolled.conversations.summaries[0].summary == "where are otters" and rolled.chunks.total == 1 + (e.stats().first().n_chunks > 1)
