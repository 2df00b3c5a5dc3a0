"""The filter audit against filters that are applied one after another."""

import random
from itertools import permutations

import duckdb

from memloom.llm import filter_audit
from memloom.llm.queries import ORACLES, QUERIES


def applied(rows, labels):
    """rows (doc_id, text, lang) through the filters in every order, document by document."""
    texts = [(i, t or "", part or "") for i, t, part in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(i, text):
        words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        out |= {"D"} if set(text) & set("#$%&*|") else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and t == text for j, t, _ in texts) else set())

    each = [(i, part, fails(i, text)) for i, text, part in texts]
    found = {}
    for part in {p for _, p, _ in each}:
        own, removed = [(i, f) for i, p, f in each if p == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed[order, step] = len(gone)
                found[part, order, step] = (len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for (p, order, step), row in list(found.items()):
            if p == part:
                found[p, order, step] = (*row, sum(n for (o, s), n in removed.items() if o[s - 1] == order[step - 1]))
    return found


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, part string, n int")
    marks = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(docs, marks).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


def test_equals_filters_applied_in_every_order(spark):
    rng = random.Random(5)
    words = [*("alpha beta gamma delta epsilon zeta".split()), "Éa", "x#y", "AB", " ", "", "a|b", *(f"w{k}" for k in range(400))]
    rows = []
    for i in range(160):
        body = rng.choice((words[:3], words[:9], words[9:12] + words[12:], words[12:]))
        rows.append((rng.choice((i, i, i, i // 2)), rng.choice((" ", "\t", "\r\n", " \x0b\x0c")).join(rng.choices(body, k=rng.choice((0, 1, 30, 199, 200, 201, 500)))), rng.choice(("en", "de", None, ""))))
    rows += [(1000 + i, rng.choice(rows)[1], "en") for i in range(60)]  # copies, some of them of other languages
    rows += [(None, None, None), (None, None, None), (2000, None, "de"), (2001, "", None), (2002, "q " * 30_000 + "Z", "en"), *(rows[:10] * 2)]
    labels = [(rng.choice((*range(160), 1003, None)), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)]
    want = applied(rows, labels)
    assert run(spark, rows, labels) == want
    assert {p for p, _, _ in want} == {"en", "de", ""} and any(sum(v[:1]) for v in want.values()) and any(v[4] and v[5] for v in want.values())


def test_hot_copies_and_an_empty_table(spark):
    rows = [(i, "same " * 210, "en") for i in range(3000)] + [(7, "same " * 210, "en")] * 50
    got = run(spark, rows, [(0, 1, 1)])
    assert got["en", "EABCD", 1][:3] == (1, 3049, 0) and got["en", "BACDE", 1][1] == 3050 and got["en", "EABCD", 1][6] == 3049 * 60
    assert run(spark, [], []) == {}


def test_query_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got = QUERIES["op11_filter_audit"](spark, sf)
    want = duck.sql(f"select {', '.join(got.columns)} from ({ORACLES['op11_filter_audit']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) % 600 == 0
