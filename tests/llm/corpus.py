"""Small corpora for the tests."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOC + ", h long, pos int, band long, keep boolean, batch int, words binary, __id long, __gone long, pages string"


def words(rng: random.Random, n: int, size: int = 4000) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def prose(rng: random.Random, n: int, size: int = 4000) -> str:
    out = []
    for i, w in enumerate(words(rng, n, size)):
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def docs(spark, texts, first_id=0):
    return spark.createDataFrame([(first_id + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], DOC)


def edge_rows():
    """Nulls in each column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 60000)
    same = prose(rng, 200)
    rows = [
        (1, None, "en", "s", None), (2, "", "en", None, 0), (3, " \n\t\n ", None, "s", 5), (None, same, "en", "s", 1), (None, None, None, None, None),
        (4, long, "en", "s", len(long)), (5, same, "en", "s", len(same)), (5, same, "en", "s", len(same)), (6, same, "en", "s", len(same)),
        (7, "x", "en", "s", 1), (8, "x", "en", "s", 1), (9, "ünïcödé 漢字 ‏ \U0001f600!", "de", "s", 3), (5, "another text", "en", "s", 12),
    ]
    return [(*r, 1, 2, 3, True, 4, b"5", 6, 7, "p") for r in rows]


def edges(spark):
    return spark.createDataFrame(edge_rows(), CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)
