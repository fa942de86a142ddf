"""WARC derivatives: each response record gives a linked metadata record and a plain-text conversion record.

All of it is Spark expressions over one scan: no shuffle and no Python. Digests are sha1 in base 32 with the label sha1:,
record ids are URNs made from an MD5 of their kind, source and payload digest, so that a lost task that runs again writes the same records and two
captures of a page are two records. Entities are those of HTML 5 that end with a semicolon, and numbers.

Nulls: a null url gives a null target_uri and a null html an empty payload; both records are made all the same. Repeated
pages give repeated records with the same ids. Very long pages are taken whole, an empty table has no record. Other columns of the input are left out.

Files are read as a stream of records. A record that is cut off, or whose length is no number, is left out, and reading goes on with the next that
can be found; so is what follows a broken place in a compressed file.
"""

from __future__ import annotations

import html as html_lib
import html.entities
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

WARC_DATE = "2024-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HIDDEN = r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>|head\b[^>]*>.*?</head\s*>|noscript\b[^>]*>.*?</noscript\s*>|!doctype[^>]*>)"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|section|article|nav|header|footer|aside|main|blockquote|pre|form|hr|dl|dt|dd|title|figure|figcaption|td|th)\b[^>]*>"
TAGS = r"<[^>]*>"
COMMON = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
RARE = r"&(?!(?:nbsp|lt|gt|quot|#39|apos|amp);)(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"
NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")} | {"nbsp": " "}
OLD = {c: ord(s) for c in range(128, 160) if (s := html_lib.unescape(f"&#{c};")) and ord(s) != c}  # numbers that mean characters of Windows-1252


def base32_sha1(c: Column) -> Column:
    hexes = F.sha1(c)
    groups = [F.lpad(F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET))


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _few(c: Column) -> Column:
    for entity, char in COMMON:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _all(c: Column) -> Column:
    """All entities, part by part of the text between ampersands."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    old = F.create_map(*[F.lit(x) for pair in OLD.items() for x in pair])

    def part(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, ENTITY, 1)
        code = F.when(F.substring(name, 2, 1).isin("x", "X"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        code = F.coalesce(old[code], code)
        code = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code).otherwise(0xFFFD)
        char = F.when(name.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise(names[name])
        return F.when(i == 0, x).when((name != "") & char.isNotNull(), F.concat(char, F.substring(x, F.length(name) + 2, F.length(x)))).otherwise(F.concat(F.lit("&"), x))

    return F.array_join(F.transform(F.split(c, "&"), part), "")


def unescape(c: Column) -> Column:
    return F.when(~F.contains(c, F.lit("&")), c).when(F.rlike(c, F.lit(RARE)), _all(c)).otherwise(_few(c))


def stripped(html: Column) -> Column:
    c = F.regexp_replace(html, HIDDEN, " ")
    c = F.regexp_replace(c, r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " ")  # not the single spaces
    return F.regexp_replace(F.regexp_replace(c, BREAKS, "\n"), TAGS, "")


def tidy(text: Column) -> Column:
    c = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.btrim(F.regexp_replace(c, r" {2,}", " "), F.lit(" \n"))


def responses(pages: DataFrame, warc_date: str = WARC_DATE) -> DataFrame:
    """The response records of a table of crawled pages (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.col("url").cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("target_uri"), html.alias("payload"), base32_sha1(html).alias("payload_digest"))
    return p.select(
        "page_id",
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.col("payload_digest")).alias("record_id"),
        "target_uri",
        F.lit(warc_date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string")).alias("http_headers"),
        "payload_digest",
        "payload",
    )


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: metadata (application/warc-fields) and conversion (text/plain).

    Both refer to the response, name each other as concurrent, and keep its date, target, HTTP headers and payload digest.
    """
    lang = F.regexp_extract("payload", r"(?i)<html\b[^>]*\blang=\"?([A-Za-z-]+)", 1)
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)
    links = F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref="))
    source = [F.col("record_id").alias("source"), "page_id", "target_uri", "warc_date", "http_headers", "payload_digest"]
    r = records.select(*source, stripped(F.col("payload")).alias("s"), title.alias("t"), lang.alias("lang"), links.alias("links"), F.octet_length("payload").alias("size"))
    # out of a generator of one row, as nothing is pushed through it: else each mention of the text would strip it anew
    r = r.select("source", "page_id", "target_uri", "warc_date", "http_headers", "payload_digest", F.inline(F.array(F.struct(F.col("s").alias("raw"), F.col("t").alias("title"), "lang", "links", "size"))))
    title = F.regexp_replace(unescape(F.col("title")), r"[\r\n]+", " ")
    r = r.select(
        "page_id", "source", "target_uri", "warc_date", "http_headers", "payload_digest", tidy(unescape(F.col("raw"))).alias("body"),
        F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), "lang", F.lit("\r\noutlinks: "), F.col("links").cast("string"), F.lit("\r\npayload-length: "), F.col("size").cast("string"), F.lit("\r\n")).alias("fields"),
    )
    ids = {k: urn(F.lit(k), F.col("source")) for k in ("metadata", "conversion")}

    def record(kind: str, other: str, content_type: str, block: str) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), ids[kind].alias("record_id"), ids[other].alias("concurrent_to"), F.lit(content_type).alias("content_type"), F.col(block).alias("block"))

    both = F.inline(F.array(record("metadata", "conversion", "application/warc-fields", "fields"), record("conversion", "metadata", "text/plain", "body")))
    rows = r.select("page_id", F.col("source").alias("refers_to"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("refers_to_payload_digest"), both)
    return rows.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", F.octet_length("block").alias("content_length"), base32_sha1(F.col("block")).alias("block_digest"), "refers_to_payload_digest", "source_headers", "block")


def serialise(derived: DataFrame) -> DataFrame:
    """One column, warc: the text of each record as WARC/1.1. Source headers are kept as WARC-Source-Header fields."""
    header = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    source = F.concat(F.array_join(F.transform(F.split("source_headers", "\r\n"), lambda x: F.concat(F.lit("WARC-Source-Header: "), x)), "\r\n"), F.lit("\r\n"))
    return derived.select(F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", "record_type"), header("WARC-Record-ID", "record_id"), header("WARC-Refers-To", "refers_to"), header("WARC-Concurrent-To", "concurrent_to"), header("WARC-Target-URI", "target_uri"),
        header("WARC-Date", "warc_date"), header("WARC-Block-Digest", "block_digest"), header("WARC-Refers-To-Payload-Digest", "refers_to_payload_digest"), F.coalesce(source, F.lit("")), header("Content-Type", "content_type"), header("Content-Length", "content_length"), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")
    ).alias("warc"))


CHUNK = 1 << 20


def unzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a file, whether of members compressed with gzip or plain; what follows a broken place is left out."""
    first = next(chunks, b"")
    if first[:2] != b"\x1f\x8b":
        yield first
        yield from chunks
        return
    inflate = zlib.decompressobj(31)
    rest = first
    while True:
        try:
            while rest:
                out = inflate.decompress(rest, CHUNK)
                if out:
                    yield out
                rest = inflate.unconsumed_tail
                if inflate.eof:
                    rest = inflate.unused_data
                    inflate = zlib.decompressobj(31)
        except zlib.error:
            return
        rest = next(chunks, b"")
        if not rest:
            return


def records(chunks: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each whole record of a plain WARC stream, of which one record is held at a time."""
    have, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        chunk = next(chunks, None)
        ended = chunk is None
        have.extend(chunk or b"")
        return not ended

    while True:
        start = have.find(b"WARC/1.")
        if start < 0:
            del have[: max(0, len(have) - 6)]
            if not more():
                return
            continue
        del have[:start]
        while (end := have.find(b"\r\n\r\n")) < 0 and len(have) < CHUNK and more():
            pass
        if end < 0:
            if ended:
                return
            del have[:7]  # no header is so long
            continue
        headers = [tuple(x.split(": ", 1)) for x in have[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x]
        length = next((v.strip() for k, v in headers if k.lower() == "content-length"), "")
        if not (length.isascii() and length.isdigit()):
            del have[:7]
            continue
        stop = end + 4 + int(length)
        while len(have) < stop and more():
            pass
        if len(have) < stop:
            return
        yield headers, bytes(have[end + 4 : stop])
        del have[:stop]


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each whole record of a WARC file, compressed or not."""
    stream = io.BytesIO(raw)
    return records(unzipped(iter(lambda: stream.read(CHUNK), b"")))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, with the columns of responses(); page_id is null. Each file is read by one task, unzipped record by record."""
    names = ["page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = memoryview(content.as_buffer())
                rows, size = [], 0
                for headers, block in records(unzipped(bytes(raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK))):
                    h = {k.lower(): v for k, v in headers}
                    if h.get("warc-type") == "response":
                        http, _, payload = block.partition(b"\r\n\r\n")
                        rows.append((None, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), http.decode("utf-8", "replace"), h.get("warc-payload-digest"), payload.decode("utf-8", "replace")))
                        size += len(block)
                        if size > 16 * CHUNK:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload_digest string, payload string")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return derive(responses(read(spark, sf_dir, "pages")))


def _sql() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def digest(c: str) -> str:
        return f"'sha1:' || list_aggregate(list_transform(range(32), lambda i: substr('{ALPHABET}', ((('0x' || substr(sha1({c}), 1 + 5 * (i // 4), 5))::INTEGER >> (5 * (3 - i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '')"

    def uid(expr: str) -> str:
        h = f"md5({expr})"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"

    def ent(c: str) -> str:
        name = f"regexp_extract(x, {q(ENTITY)}, 1)"
        old = "MAP {" + ", ".join(f"{k}: {v}" for k, v in OLD.items()) + "}"
        code = f"CASE WHEN substr({name}, 2, 1) IN ('x', 'X') THEN ('0x' || substr({name}, 3))::INTEGER ELSE substr({name}, 2)::INTEGER END"
        code = f"coalesce({old}[{code}], {code})"
        char = f"CASE WHEN {name} LIKE '#%' THEN CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}) ELSE chr(65533) END ELSE m[{name}] END"
        part = f"CASE WHEN i = 1 THEN x WHEN {name} != '' AND {char} IS NOT NULL THEN {char} || substr(x, length({name}) + 2) ELSE '&' || x END"
        return f"list_aggregate(list_transform(string_split({c}, '&'), lambda x, i: {part}), 'string_agg', '')"

    sub = lambda c, pattern, to: f"regexp_replace({c}, {q(pattern)}, {to}, 'g')"
    text = sub("payload", HIDDEN, "' '")
    text = sub(text, r"[ \t\r\n\f]+", "' '")
    text = sub(text, BREAKS, "chr(10)")
    text = ent(sub(text, TAGS, "''"))
    text = sub(text, r" *\n[ \n]*", "chr(10)")
    text = sub(sub(text, " +", "' '"), r"^[ \n]+|[ \n]+$", "''")
    crlf = "chr(13) || chr(10)"
    fields = f"""'title: ' || {sub(ent("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)"), "[\\r\\n]+", "' '")} || {crlf} || 'language: ' || regexp_extract(payload, '(?i)<html\\b[^>]*\\blang="?([A-Za-z-]+)', 1) || {crlf} || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref='))::VARCHAR || {crlf} || 'payload-length: ' || strlen(payload)::VARCHAR || {crlf}"""
    return f"""
    WITH named AS MATERIALIZED (SELECT {"MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NAMED.items()) + "}"} AS m),
    p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, named.m FROM pages, named),
    r AS (SELECT page_id, {uid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(target_uri, '') || '|' || " + digest("payload"))} AS source, target_uri,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload)::VARCHAR AS source_headers,
        {digest("payload")} AS refers_to_payload_digest, {text} AS body, {fields} AS fields FROM p),
    b AS (SELECT *, 'metadata' AS record_type, 'conversion' AS other, 'application/warc-fields' AS content_type, fields AS block FROM r
        UNION ALL SELECT *, 'conversion', 'metadata', 'text/plain', body FROM r)
    SELECT page_id, record_type, {uid("record_type || '|' || source")} AS record_id, source AS refers_to, {uid("other || '|' || source")} AS concurrent_to, target_uri,
        '{WARC_DATE}' AS warc_date, content_type, strlen(block)::INTEGER AS content_length, {digest("block")} AS block_digest, refers_to_payload_digest, source_headers, block FROM b"""


SQL = {"op2_warc": _sql()}
