"""Porter's stemmer. Spark has none, so it runs as an Arrow-batched UDF; callers stem distinct words and join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STEP2 = "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log"
STEP3 = "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
PAIRS2 = [tuple(x.split(">")) for x in STEP2.split()]
PAIRS3 = [tuple(x.split(">")) for x in STEP3.split()]


def pattern(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = []
    for ch in word:
        out.append("v" if ch in "aeiou" or (ch == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def measure(stem: str) -> int:
    return pattern(stem).count("vc")


def _short(word: str) -> bool:
    return pattern(word).endswith("cvc") and word[-1] not in "wxy"


def _rules(word: str, pairs: list[tuple[str, str]]) -> str:
    for suffix, to in pairs:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if measure(stem) > 0 else word
    return word


def _plurals(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if "v" not in pattern(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and pattern(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _step4(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return w
            return stem if measure(stem) > 1 else w
    return w


def _step5(w: str) -> str:
    m = measure(w)  # of the whole word, for both tests below
    if w.endswith("e") and (m > 1 or (m == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """Words of up to 2 and of more than 255 characters stay."""
    if len(word) <= 2 or len(word) > 255:
        return word
    w = _plurals(word)
    if len(w) > 1:
        if w.endswith("y") and "v" in pattern(w[:-1]):
            w = w[:-1] + "i"
        w = _step5(_step4(_rules(_rules(w, PAIRS2), PAIRS3)))
    return w


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def with_stems(terms: DataFrame, column: str = "keyword") -> DataFrame:
    """Adds `stem`; each distinct word is stemmed once."""
    dictionary = terms.select(column).distinct().withColumn("stem", stem_column(column))
    return terms.join(dictionary, column)


def sql(words: str) -> str:
    """CTEs (without WITH) that end in porter(word, stem), over a query `words` with the column word: the same stemmer in SQL."""
    cv = "list_reduce(string_split(w, ''), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END, '')"
    m = lambda n: f"((length(left(c, length(w) - {n})) - length(replace(left(c, length(w) - {n}), 'vc', ''))) // 2)"
    cut = lambda n: f"left(w, length(w) - {n})"

    def cases(pairs: list[tuple[str, str]], least: int) -> str:
        out = []
        for suffix, to in pairs:
            n = len(suffix)
            extra = f" AND right({cut(n)}, 1) IN ('s', 't')" if suffix == "ion" else ""
            out.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN {m(n)} > {least}{extra} THEN {cut(n)} || '{to}' ELSE w END")
        return "CASE " + " ".join(out) + " ELSE w END"

    def step(name: str, source: str, expr: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT word, CASE WHEN live AND length(w) > 1 THEN {expr} ELSE w END AS w, live FROM (SELECT *, {cv} AS c FROM {source}))"

    short = lambda n: f"(right(left(c, length(w) - {n}), 3) = 'cvc' AND right({cut(n)}, 1) NOT IN ('w', 'x', 'y'))"
    repair = lambda n: f"""CASE WHEN NOT contains(left(c, length(w) - {n}), 'v') THEN w WHEN right({cut(n)}, 2) IN ('at', 'bl', 'iz') THEN {cut(n)} || 'e'
        WHEN length(w) - {n} > 1 AND right({cut(n)}, 1) = right({cut(n + 1)}, 1) AND right(left(c, length(w) - {n}), 1) = 'c' THEN CASE WHEN right({cut(n)}, 1) IN ('l', 's', 'z') THEN {cut(n)} ELSE {cut(n + 1)} END
        WHEN {m(n)} = 1 AND {short(n)} THEN {cut(n)} || 'e' ELSE {cut(n)} END"""  # noqa: E731
    return ",\n".join(
        [
            f"p0 AS MATERIALIZED (SELECT DISTINCT word, word AS w, length(word) BETWEEN 3 AND 255 AS live FROM ({words}))",
            step("p1", "p0", f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {cut(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {cut(1)} ELSE w END"),
            step("p2", "p1", f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {m(3)} > 0 THEN {cut(1)} ELSE w END WHEN suffix(w, 'ed') THEN {repair(2)} WHEN suffix(w, 'ing') THEN {repair(3)} ELSE w END"),
            step("p3", "p2", f"CASE WHEN suffix(w, 'y') AND contains(left(c, length(w) - 1), 'v') THEN {cut(1)} || 'i' ELSE w END"),
            step("p4", "p3", cases(PAIRS2, 0)),
            step("p5", "p4", cases(PAIRS3, 0)),
            step("p6", "p5", cases([(s, "") for s in STEP4], 1)),
            step("p7", "p6", f"CASE WHEN suffix(w, 'll') AND {m(0)} > 1 THEN {cut(1)} WHEN suffix(w, 'e') AND ({m(0)} > 1 OR ({m(0)} = 1 AND NOT {short(1)})) THEN CASE WHEN {m(0)} > 1 AND suffix({cut(1)}, 'll') THEN {cut(2)} ELSE {cut(1)} END ELSE w END"),
            "porter AS MATERIALIZED (SELECT word, w AS stem FROM p7)",
        ]
    )
