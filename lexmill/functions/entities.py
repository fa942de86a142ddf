"""Named entities: runs of capitalised words, also through connectors, and acronyms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NAME_CONNECTORS, NO_NAMES

_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z][A-Za-z0-9]*)*")
_TITLE = re.compile(r"[A-Z](?:[A-Za-z0-9'-]*[a-z][A-Za-z0-9'-]*)?")
_CAPS = re.compile(r"[A-Z.-]{2,10}")


def normalise(text: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"[ '-]+", "_", text.lower())).lstrip("_").rstrip("_")


def _is_name(token: str) -> bool:
    return bool(_TITLE.fullmatch(token)) and token.lower() not in NO_NAMES


def extract(text: str | None) -> list[tuple[str, str, int]]:
    """(text, normal form, number of words), each normal form once: names of two words and more first, then acronyms."""
    toks = _TOKEN.findall(text or "")
    found: dict[str, tuple[str, str, int]] = {}
    i, n = 0, len(toks)
    while i < n:
        if not _is_name(toks[i]):
            i += 1
            continue
        end = i + 1
        while end < n:
            if _is_name(toks[end]):
                end += 1
            elif toks[end].lower() in NAME_CONNECTORS and end + 1 < n and _is_name(toks[end + 1]):
                end += 2
            else:
                break
        if end - i > 1:
            name = " ".join(toks[i:end])
            key = normalise(name)
            if len(key) >= 3:
                found.setdefault(key, (name, key, end - i))
        i = end
    for t in toks:
        if _CAPS.fullmatch(t):
            key = re.sub("[^A-Z]", "", t).lower()
            if len(key) >= 2:
                found.setdefault(key, (t, key, 1))
    return list(found.values())


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each entity of each document: key, ordinal, entity, normalized, token_count."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *e) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, e in enumerate(extract(t))]
            columns = list(zip(*rows)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "ordinal", "entity", "normalized", "token_count"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, ordinal int, entity string, normalized string, token_count int")
