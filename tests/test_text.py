import random

import pytest
from pyspark.sql import functions as F

from lexmill import constants as C
from lexmill.functions import entities, porter
from lexmill.functions import text as T

PAIRS = "caresses>caress ponies>poni cats>cat agreed>agre plastered>plaster motoring>motor hopping>hop falling>fall filing>file happy>happi sky>sky relational>relat conditional>condit vileli>vile analogousli>analog triplicate>triplic formative>form electrical>electr goodness>good revival>reviv adoption>adopt controll>control roll>roll probate>probat rate>rate cease>ceas feed>feed sized>size tanned>tan"


def test_stemmer():
    for pair in PAIRS.split():
        word, stem = pair.split(">")
        assert porter.stem(word) == stem
    assert [porter.stem(w) for w in ("", "a", "is", "x" * 300, "b2bing", "abc_def")] == ["", "a", "is", "x" * 300, "b2bing", "abc_def"]


def test_stemmer_in_sql_agrees():
    import duckdb

    rng = random.Random(1)
    ends = [a for a, _ in porter.PAIRS2 + porter.PAIRS3] + porter.STEP4 + ["ed", "ing", "eed", "s", "ies", "sses", "y", "e", "ll", "es"]
    vocabulary = sorted({"".join(rng.choice("abcdeilnorstyz_1") for _ in range(rng.randrange(0, 8))) + rng.choice(ends) + rng.choice(["", rng.choice(ends)]) for _ in range(4000)})
    con = duckdb.connect()
    con.execute("CREATE TABLE v (word VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [[w] for w in vocabulary])
    got = dict(con.execute(f"WITH {porter.sql('SELECT word FROM v')} SELECT word, stem FROM porter").fetchall())
    assert got == {w: porter.stem(w) for w in vocabulary}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def plain_tokens(text):
    out, word = [], ""
    for ch in text + " ":
        if ch.isascii() and ch.isalnum():
            word += ch.lower()
        else:
            if len(word) <= 30 and (len(word) >= 3 or word in C.SHORT_WORDS) and word not in C.STOP_WORDS:
                out.append(word)
            word = ""
    return out


def test_tokens_equal_a_scanner(spark):
    rng = random.Random(2)
    texts = ["", "...", "a" * 30, "a" * 31, "AI os xx", "Kelvin cafés", "x_y 12ab the THE Then", "tea tea tea"] + ["".join(rng.choice("abAI _.1é\nKthe") for _ in range(60)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.tokens(F.col("t")).alias("x"), T.bigrams(T.tokens(F.col("t"))).alias("b")).collect()
    for r in rows:
        toks = plain_tokens(texts[r.i])
        assert r.x == toks
        assert r.b == [f"{a}_{b}" for a, b in zip(toks, toks[1:]) if len(a) + len(b) < 61]
    assert one(spark, T.tokens, None) == []


def test_snippets_and_context(spark):
    assert one(spark, T.snippet, "short") == "short"
    assert one(spark, T.snippet, "x" * 300) == "x" * 200 + "..."
    assert one(spark, T.snippet, "x" * 150 + " " + "y" * 200) == "x" * 150 + "..."
    assert one(spark, T.snippet, "x" * 50 + " " + "y" * 300) == "x" * 50 + " " + "y" * 149 + "..."
    cut = lambda c: T.truncate_context(c, 100, "~")
    assert one(spark, cut, "a" * 90 + "." + "b" * 50) == "a" * 90 + ".~"
    assert one(spark, cut, "a." + "b" * 200) == "a." + "b" * 98 + "~"
    assert one(spark, T.printable, "a\tbé\x01c") == "a bc"
    assert one(spark, T.json_safe, 'a"\\\né\x01') == 'a\\"\\\\\\n '


@pytest.mark.parametrize("text,expected", [("My name?", True), ("dummy x", False), ("tell me now", True), ("tell me", False), ("alibi in court", False), ("what did we discuss", True), ("plain words", False), ("", False)])
def test_self_reference(spark, text, expected):
    assert one(spark, T.is_self_reference, text) is expected


def test_ids_and_types(spark):
    assert one(spark, T.chunk_ids, "a_DOC_1, CH5; b.2 CH5 code_001") == ["a_DOC_1", "CH5", "b.2"]
    assert one(spark, T.chapter_code, "Physics Notes.v2.txt") == "physcsnt" and one(spark, T.chapter_code, "2021-03.md") == "202103" and one(spark, T.chapter_code, "aeiou.txt") == "unk"
    assert one(spark, T.content_type, "x.py.txt") == "CODE" and one(spark, T.type_of_id, "CH9") == "CHAT" and one(spark, T.type_of_id, "a_FIX_1") == "FIX"
    assert one(spark, T.judge_verdict, "REFINE:  more ") == (False, "more") and one(spark, T.judge_verdict, "whatever") == (True, "")


def test_entities(spark):
    got = entities.extract("The United States of America and NASA met Jean-Luc Picard. What Bob said to IBM")
    assert [(e[1], e[2]) for e in got] == [("united_states_of_america", 4), ("jean_luc_picard", 2), ("nasa", 1), ("ibm", 1)]
    df = spark.createDataFrame([(1, "Ada Lovelace"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.normalized) for r in entities.entities(df).collect()] == [(1, "ada_lovelace")]
