import base64
import gzip
import hashlib

from lexmill.llm import warc

PAGES = "page_id long, url string, html string, record_id string, payload string, block string, source string"


def rows(spark):
    html = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t="</p>";</script><!-- x --><p>One <b>two</b></p><div>Three&lt;4 <a href="/x">link</a></div></body></html>'
    data = [(1, "http://a/", html), (2, None, html), (3, "http://b/", None), (None, "http://c/", ""), (1, "http://a/", html), (4, "http://d/", "é <p>" * 50000)]
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in data], PAGES), html


def sha(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_records_are_linked_and_keep_the_source(spark):
    pages, html = rows(spark)
    out = warc.derive(warc.responses(pages)).collect()
    assert len(out) == 12
    by = {(r.page_id, r.record_type): r for r in out}
    m, c = by[1, "metadata"], by[1, "conversion"]
    assert c.block == "One two\nThree<4 link" and m.block.startswith("title: A & B\r\nlanguage: fr\r\noutlinks: 1\r\n")
    response = warc.responses(pages).where("page_id = 1").first()
    assert m.refers_to == c.refers_to == response.record_id and m.concurrent_to == c.record_id and c.concurrent_to == m.record_id
    assert m.refers_to_payload_digest == c.refers_to_payload_digest == sha(html.encode())
    for r in out:
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
    assert m.source_headers == response.http_headers and by[2, "metadata"].target_uri is None
    assert by[3, "conversion"].block == "" and len({r.record_id for r in out}) == 10


def test_serialised_records_parse_again(spark):
    pages, _ = rows(spark)
    derived = warc.derive(warc.responses(pages))
    raw = "".join(r.warc for r in warc.serialise(derived).collect()).encode()
    for data in (raw, gzip.compress(raw)):
        parsed = [(dict(h), b) for h, b in warc.parse(data)]
        assert sorted(b for _, b in parsed) == sorted(r.block.encode() for r in derived.collect())
        assert {h["WARC-Refers-To"] for h, _ in parsed} == {r.refers_to for r in derived.collect()}
        assert any("WARC-Source-Header" in h for h, _ in parsed)
    assert len(list(warc.parse(raw[:-20]))) == len(parsed) - 1


def test_responses_from_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record * 2))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert len(got) == 2 and got[0].payload == "<p>hello</p>" and got[0].http_headers.endswith("Server: x")
    assert warc.derive(warc.read_responses(spark, str(tmp_path))).where("record_type = 'conversion' and block = 'hello'").count() == 2


def test_empty_table(spark):
    pages, _ = rows(spark)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_two_captures_of_a_page_are_two_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>a"), (1, "http://a/", "<p>b"), (1, "http://a/", "<p>b")], "page_id long, url string, html string")
    assert len({r.record_id for r in warc.responses(pages).collect()}) == 2
    assert len({r.record_id for r in warc.derive(warc.responses(pages)).collect()}) == 4


def test_entities_are_those_of_html(spark):
    import html

    import duckdb
    import pandas as pd

    texts = ["caf&eacute; &#8217;x&#x2019; &#X41;", "&amp;lt; &lt;&gt;", "&copy;2 &notit; &unknown; & &; &#; &#x; AT&T;", "&#150;&#128;&#0;&#55296;&#1114112;&#9999999;", "&NotEqualTilde;&hellip;&amp;&hellip;", "&nbsp;a&nbsp;&euro;", "no entity", "&#128512; end&"]
    pages = pd.DataFrame({"page_id": range(len(texts)), "url": "u", "html": texts})
    got = {r.page_id: r for r in warc.derive(warc.responses(spark.createDataFrame(pages))).where("record_type = 'conversion'").collect()}
    for i in (0, 1, 4, 5, 6, 7):
        assert got[i].block == html.unescape(texts[i]).replace("\xa0", " ").strip(), i
    assert got[2].block == "©2 &notit; &unknown; & &; &#; &#x; AT&T;" and got[3].block == "–€" + "�" * 4
    con = duckdb.connect()
    con.register("pages", pages)
    expected = con.execute(warc.SQL["op2_warc"]).fetchdf()
    expected = expected[expected.record_type == "conversion"]
    assert {r.page_id: (r.block, r.record_id) for r in expected.itertuples()} == {i: (r.block, r.record_id) for i, r in got.items()}


def test_broken_files_give_their_whole_records(spark, tmp_path):
    record = lambda length, body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (length, body)
    body = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(32, 120)) * 40
    good = record(b"%d" % len(body), body)
    zipped = gzip.compress(good)
    files = {
        "cut.warc.gz": (zipped * 2)[:-40], "damaged.warc.gz": zipped + zipped[:60] + b"\0\1\2" * 9 + zipped[90:] + zipped, "length.warc": record(b"many", b"x") + good + record(b"-4", b"y") + good, "long.warc": good + record(b"99999999", b"z"), "noise.warc": b"WARC/1.1\r\nno end of the header " * 50 + good, "zero.warc": b"",
    }
    counts = {"cut.warc.gz": 1, "damaged.warc.gz": 1, "length.warc": 2, "long.warc": 1, "noise.warc": None, "zero.warc": 0}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        found = list(warc.parse(data))
        assert counts[name] is None or [b for _, b in found] == [body] * counts[name], name
    assert warc.read_responses(spark, str(tmp_path)).where("length(payload) > 3000").count() >= 5
    many = good * 5000  # records pass through one at a time, also where they cross the pieces that are read
    assert sum(b == body for _, b in warc.parse(gzip.compress(many, 1))) == 5000
