"""Quality rules: an ordered decision list of threshold conjunctions, learned from labelled statistics.

Sequential covering: a rule is grown on two thirds of the labelled rows by adding, one after another, the threshold condition
with the largest information gain for the bad class, pruned on the other third by cutting trailing conditions while its
worth (p - n) / (p + n) does not fall, kept if its precision there is high enough, and the rows that it covers are set
aside before the next. The list is emitted as one ordered Spark CASE expression over statistics that Spark computes with
built-in functions; applying it is a single scan without a shuffle.

The rules are fitted on at most `max_rows` labelled documents of each class, those with the least hash of doc_id, so the sample
does not depend on partitioning; of several texts under one doc_id the least stands. Labels that contradict each other (or are null) are left out. All
places between two different values of a statistic are tried as thresholds; growing ends when no condition gains anything, and the
list when its next rule is not precise (MIN_PRECISION) or covers fewer than MIN_COVER bad rows. Equal gains go to the statistic listed first and the least threshold. Without enough labels of both classes, or of
an empty table, the list is empty and keeps everything.

Each row of the table gets its decision, repeated rows the same one. Documents without a rule that fires are kept, and so are null and empty texts: all
their statistics are 0. Very long texts are counted whole. Other columns are kept by apply(), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_name, read

MAX_ROWS = 4000
MIN_PRECISION = 0.9
MIN_COVER = 5


COUNTS = {
    "words": r"\S+", "spaces": r"\s", "upper": r"\p{Lu}", "digits": r"[0-9]", "symbols": r"[#$%&*@^~=+<>{}\[\]|\\_]", "exclaims": r"[!?]", "bars": r"[|]", "stops": r"[.,;:]", "breaks": r"\n",
}
STATISTICS = {
    "n_chars": (("chars",), lambda r: r["chars"]),
    "n_words": (("words",), lambda r: r["words"]),
    "mean_word": (("chars", "spaces", "words"), lambda r: _per(r["chars"] - r["spaces"], r["words"])),
    "upper": (("upper", "chars"), lambda r: _per(r["upper"], r["chars"])),
    "digits": (("digits", "chars"), lambda r: _per(r["digits"], r["chars"])),
    "symbols": (("symbols", "words"), lambda r: _per(r["symbols"], r["words"])),
    "exclaims": (("exclaims", "words"), lambda r: _per(r["exclaims"], r["words"])),
    "bars": (("bars", "words"), lambda r: _per(r["bars"], r["words"])),
    "stops": (("stops", "words"), lambda r: _per(r["stops"], r["words"])),
    "lines": (("breaks", "words"), lambda r: _per(r["breaks"] + 1.0, r["words"])),
}


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counts(text: Column, names: set[str] | None = None) -> dict[str, Column]:
    """What is counted in a text, as doubles: characters and matches."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return {n: (F.length(t) if n == "chars" else F.regexp_count(t, F.lit(COUNTS[n]))).cast("double") for n in ("chars", *COUNTS) if names is None or n in names}


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, as doubles."""
    r = counts(text)
    return {n: f(r) for n, (_, f) in STATISTICS.items()}


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the documents whose labels agree."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    return clean.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__hi")).where("quality = __hi").drop("__hi")


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, quality, text (the least one) of at most max_rows labelled documents a class."""
    clean = clean_labels(labels)
    picked = None
    for q in (0, 1):
        part = clean.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * max_rows pairs of numbers
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


Condition = tuple[str, str, float]


def _holds(x: dict[str, np.ndarray], c: Condition) -> np.ndarray:
    return x[c[0]] <= c[2] if c[1] == "<=" else x[c[0]] > c[2]


def _covers(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= _holds(x, c)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(bad), dtype=bool)
    while bad[live].any() and not bad[live].all():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, values in x.items():
            order = np.argsort(values[live], kind="stable")
            v, b = values[live][order], bad[live][order]
            at = np.flatnonzero(v[1:] > v[:-1])
            cuts = (v[at + 1] + v[at]) / 2
            cuts = np.where(cuts < v[at + 1], cuts, v[at])
            under = np.cumsum(b)[at]
            for op in ("<=", ">"):
                p = under if op == "<=" else p0 - under
                n = (at + 1 if op == "<=" else len(v) - at - 1) - p
                gain = np.where(p >= MIN_COVER, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), (name, op, float(cuts[gain.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _holds(x, best[1])
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, rule: list[Condition]) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        hit = _covers(x, r)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(rows) -> list[dict]:
    """The list, from a pandas frame with the statistics, quality and doc_id: rules with conditions and precision, best first as found."""
    if not len(rows) or rows["quality"].nunique() < 2:
        return []
    rows = rows.sort_values("doc_id", kind="stable")
    names = [c for c in rows.columns if c not in ("doc_id", "quality")]
    x = {c: rows[c].to_numpy(float) for c in names}
    bad = rows["quality"].to_numpy() == 0
    prune = np.zeros(len(bad), dtype=bool)
    for side in (False, True):
        prune[np.flatnonzero(bad == side)[2::3]] = True
    rules: list[dict] = []
    live = np.ones(len(bad), dtype=bool)
    while True:
        part = lambda m: ({c: v[m & live] for c, v in x.items()}, bad[m & live])
        gx, gb = part(~prune)
        px, pb = part(prune)
        if gb.sum() < MIN_COVER or not len(pb):
            break
        rule = _grow(gx, gb)
        if not rule:
            break
        rule = _prune(px, pb, rule)
        hit = _covers(px, rule)
        both = _covers({c: v[live] for c, v in x.items()}, rule)
        p, n = int((both & bad[live]).sum()), int((both & ~bad[live]).sum())
        held = (hit & pb).sum() / max(1, hit.sum())
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION or (hit.any() and held < MIN_PRECISION):
            break
        rules.append({"conditions": rule, "precision": round(p / (p + n), 6), "covered": p + n})
        live &= ~_covers(x, rule)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[dict]:
    s = sample(docs, labels, max_rows)
    return learn(s.select("doc_id", "quality", *[c.alias(n) for n, c in statistics(F.col("text")).items()]).toPandas())


def expressions(rules: list[dict], stats: dict[str, Column]) -> tuple[Column, Column]:
    """The number of the first rule that fires (0: none), and that rule's precision (null: none)."""
    number, precision = None, None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, cut in rule["conditions"]:
            test = test & (stats[name] <= F.lit(cut) if op == "<=" else stats[name] > F.lit(cut))
        number = F.when(test, i) if number is None else number.when(test, i)
        precision = F.when(test, F.lit(rule["precision"])) if precision is None else precision.when(test, F.lit(rule["precision"]))
    if number is None:
        return F.lit(0), F.lit(None).cast("double")
    return number.otherwise(0), precision.otherwise(F.lit(None).cast("double"))


def with_statistics(docs: DataFrame, rules: list[dict]) -> tuple[DataFrame, dict[str, Column]]:
    """docs with the counts that the rules need, each made once, and the statistics as expressions of these.

    The counts come out of a generator of one row, which no condition is pushed through: else each condition would count anew.
    """
    used = {c[0] for r in rules for c in r["conditions"]}
    needed = {n for s in used for n in STATISTICS[s][0]}
    if not needed:
        return docs, {}
    made = {n: own_name(docs, f"__count_{n}") for n in needed}
    kept = {n: own_name(docs, f"__{n}") for n in needed}
    d = docs.select("*", *[c.alias(made[n]) for n, c in counts(F.col("text"), needed).items()])
    d = d.select("*", F.inline(F.array(F.struct(*[F.col(made[n]).alias(kept[n]) for n in sorted(needed)]))))
    raw = {n: F.col(c) for n, c in kept.items()}
    return d, {s: STATISTICS[s][1](raw) for s in used}


def decide(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """doc_id, rule, precision, keep for each row of docs."""
    d, names = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    number, precision = expressions(rules, names)
    return d.select("doc_id", number.cast("int").alias("rule"), precision.alias("precision"), (number == 0).alias("keep"))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    rules = fit(docs, labels)
    d, names = with_statistics(docs, rules)
    number, _ = expressions(rules, names)
    return d.where(number == 0).select(*docs.columns)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decide(docs, fit(docs, read(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
