import random

from pyspark.sql import functions as F

from lexmill.llm import decision_list as dl
from tests.llm import corpus
from tests.llm.test_quality_classifier import LABELS, labelled


def test_rules_find_the_bad_and_leave_the_good(spark):
    docs, labels, rows = labelled(spark)
    rules = dl.fit(docs.where("doc_id < 160"), labels)
    assert rules and all(r["precision"] >= dl.MIN_PRECISION for r in rules)
    got = {r.doc_id: r.keep for r in dl.decide(docs, rules).collect()}
    held = [(got[i], q) for i, q, *_ in rows if i >= 160]
    assert sum(k for k, q in held if q) >= 0.97 * sum(q for _, q in held) and not any(k for k, q in held if not q)


def test_first_rule_that_fires_decides_as_in_plain_python(spark):
    docs, _, _ = labelled(spark)
    rules = [{"conditions": [("symbols", ">", 0.3), ("n_words", "<=", 200.0)], "precision": 0.9}, {"conditions": [("exclaims", ">", 0.2)], "precision": 0.8}]
    stats = docs.select("doc_id", *[c.alias(n) for n, c in dl.statistics(F.col("text")).items()]).collect()

    def plain(s):
        for i, r in enumerate(rules, 1):
            if all((s[n] <= c) if op == "<=" else (s[n] > c) for n, op, c in r["conditions"]):
                return i
        return 0

    assert {r.doc_id: r.rule for r in dl.decide(docs, rules).collect()} == {s.doc_id: plain(s) for s in stats}
    text = "Ab, c!! 12 |"
    s = spark.createDataFrame([(text,)], "text string").select(*[c.alias(n) for n, c in dl.statistics(F.col("text")).items()]).first()
    assert (s.n_chars, s.n_words, s.mean_word, s.upper, s.digits, s.symbols, s.exclaims, s.bars, s.stops, s.lines) == (12, 4, 9 / 4, 1 / 12, 2 / 12, 0.25, 0.5, 0.25, 0.25, 0.25)


def test_pruning_and_order_do_not_depend_on_partitions(spark):
    docs, labels, _ = labelled(spark)
    assert dl.fit(docs.repartition(7), labels.repartition(3)) == dl.fit(docs.coalesce(1), labels)


def test_edges(spark):
    docs, labels, _ = labelled(spark)
    rules = dl.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0, "x"), (1, None, 0, None), (2, 0, 0, ""), (2, 1, 0, "")], LABELS)))
    out = dl.decide(corpus.edges(spark), rules).collect()
    assert len(out) == len(corpus.edge_rows()) and all(r.keep for r in out if r.doc_id in (1, 2))
    assert dl.decide(corpus.empty(spark), rules).count() == 0
    assert dl.fit(corpus.empty(spark), labels) == [] and dl.fit(docs, labels.where("quality = 1")) == []
    assert dl.apply(corpus.edges(spark), labels.limit(0)).columns == corpus.edges(spark).columns
    assert random.Random(1).random() and all(r.keep and r.rule == 0 for r in dl.decide(docs, []).collect())


def plain_grow(rows, names):
    """The best condition by information gain again and again, every threshold tried one by one."""
    import math

    rule, live = [], list(rows)
    while any(r["bad"] for r in live) and not all(r["bad"] for r in live):
        p0 = sum(r["bad"] for r in live)
        base, best = math.log2(p0 / len(live)), (0.0, None)
        for name in names:
            values = sorted({r[name] for r in live})
            for op in ("<=", ">"):
                for a, b in zip(values, values[1:]):
                    hit = [r for r in live if (r[name] <= a) == (op == "<=")]
                    p = sum(r["bad"] for r in hit)
                    gain = p * (math.log2(p / len(hit)) - base) if p >= dl.MIN_COVER else -1
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, op, (a + b) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        live = [r for r in live if (r[best[1][0]] <= best[1][2]) == (best[1][1] == "<=")]
    return rule


def holds(r, rule):
    return all((r[n] <= c) == (op == "<=") for n, op, c in rule)


def test_learning_against_brute_force():
    import pandas as pd

    rng = random.Random(3)
    rows = []
    for i in range(400):
        r = {"doc_id": i, "a": rng.random(), "b": float(rng.randrange(6)), "c": rng.random()}
        r["bad"] = (r["a"] > 0.8 and r["c"] < 0.6) or r["b"] == 5 or rng.random() < 0.03
        rows.append(r)
    frame = pd.DataFrame(rows)
    frame["quality"] = 1 - frame.pop("bad").astype(int)
    sides = {s: [r for r in rows if r["bad"] == s] for s in (True, False)}
    prune = {r["doc_id"] for s in sides.values() for r in s[2::3]}
    live, expected = rows, []
    while True:
        grow, rest = [r for r in live if r["doc_id"] not in prune], [r for r in live if r["doc_id"] in prune]
        if sum(r["bad"] for r in grow) < dl.MIN_COVER or not rest:
            break
        rule = plain_grow(grow, "abc")
        if not rule:
            break

        def worth(x, rest=rest):
            hit = [r["bad"] for r in rest if holds(r, x)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit, both = [r["bad"] for r in rest if holds(r, rule)], [r["bad"] for r in live if holds(r, rule)]
        if sum(both) < dl.MIN_COVER or sum(both) / len(both) < dl.MIN_PRECISION or (hit and sum(hit) / len(hit) < dl.MIN_PRECISION):
            break
        expected.append({"conditions": rule, "precision": round(sum(both) / len(both), 6), "covered": len(both)})
        live = [r for r in live if not holds(r, rule)]
    got = dl.learn(frame)
    assert len(expected) >= 2 and [r["covered"] for r in got] == [r["covered"] for r in expected]
    for g, e in zip(got, expected):
        assert g["precision"] == e["precision"] and [c[:2] for c in g["conditions"]] == [c[:2] for c in e["conditions"]]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(g["conditions"], e["conditions"]))


def test_repeated_rows_do_not_swell_the_sample(spark):
    docs, labels, _ = labelled(spark)
    again = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id < 9"))
    assert dl.sample(again, labels).count() == 240 and dl.fit(again, labels) == dl.fit(docs, labels)
    rules = dl.fit(docs, labels)
    assert dl.apply(again, labels).count() == again.count() - 3 * sum(not r.keep for r in dl.decide(docs.where("doc_id < 9"), rules).collect()) - sum(not r.keep for r in dl.decide(docs.where("doc_id >= 9"), rules).collect())
