"""Hallways kept by deltas against a full computation, and the interval join against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import facts as kg
from memloom.operators import graph

DRAWER = "id int, wing string, room string, entities array<string>"


def test_random_deltas_equal_a_recompute(spark, tmp_path):
    rng = random.Random(9)
    table = graph.pair_table(spark, str(tmp_path / "pairs"), buckets=8)
    there, serial = {}, 0
    for batch in range(4):
        gone = rng.sample(sorted(there), k=min(len(there), 12))
        new = {}
        for _ in range(rng.choice((5, 40))):
            serial += 1
            new[serial] = (serial, rng.choice(("w0", "w1", "w2")), rng.choice(("r1", "r2", "", None)), [rng.choice((*"ABCDEF", " ")) for _ in range(rng.randint(0, 5))])
        removed = spark.createDataFrame([there.pop(i) for i in gone], DRAWER)
        there |= new
        for _again in range(2):
            graph.apply_drawers(table, f"b{batch}", spark.createDataFrame(list(new.values()), DRAWER), removed)
        want = graph.hallways(spark.createDataFrame(list(there.values()), DRAWER))
        columns = ["wing", "entity_a", "entity_b", "together", "rooms", "id", "label"]
        got = graph.maintained_hallways(table.read())
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    one = spark.createDataFrame([(0, "w0", "r1", ["A", "B"])], DRAWER)
    version = graph.apply_drawers(table, "one", one)
    assert len(table.commit_of(version)["rewritten"]) == 1  # the cost goes with the change
    changed = graph.maintained_hallways(table.rewritten(version)).where("wing = 'w0' and entity_a = 'A' and entity_b = 'B'")
    assert changed.first().together == graph.maintained_hallways(table.read()).where("wing = 'w0' and entity_a = 'A' and entity_b = 'B'").first().together
    with pytest.raises(Exception, match="isn't there"):
        graph.apply_drawers(table, "bad", one.limit(0), spark.createDataFrame([(0, "w9", "r1", ["X", "Y"])], DRAWER))


def test_interval_join_equals_every_pair(spark):
    rng = random.Random(10)
    day = lambda: f"{rng.choice((1700, 1999, 2024, 2024, 2024, 2500))}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    moment = lambda: day() + rng.choice(("", "", f"T{rng.randint(0, 23):02d}:30:00Z"))
    rows = []
    for i in range(300):
        a, b = sorted((moment(), moment()))
        rows.append((f"f{i}", rng.choice(("Al Bo", "Cy", "Di")), "likes", rng.choice(("Tea", "Cy")), rng.choice((a, a, "")), rng.choice((b, b, ""))))
    facts = spark.createDataFrame(rows, "id string, subject string, predicate string, object string, valid_from string, valid_to string")
    asked = [(k, rng.choice(("al bo", "Cy", "nobody")), moment()) for k in range(60)] + [(100, "Cy", None), (101, "Cy", "soon"), (102, "Cy", ""), (103, "Cy", "2024-02-01T00:00:00+00:00")]
    questions = spark.createDataFrame(asked, "question_id int, entity string, as_of string")
    for side in ("subject", "object"):
        got = kg.in_effect_for(facts, questions, side)
        want = set()
        for k, entity, at in asked:
            if at and at != "soon":
                own = facts.where(kg.entity_id(F.col(side)) == kg.entity_id(F.lit(entity))).where(kg.in_effect(at.replace("+00:00", "Z")))
                want |= {(k, r.id) for r in own.select("id").collect()}
        assert sorted((r.question_id, r.id) for r in got.collect()) == sorted(want) and len(want) > 100
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert kg.in_effect_for(kg.normalised(facts), questions).count() == kg.in_effect_for(facts, questions).count()
