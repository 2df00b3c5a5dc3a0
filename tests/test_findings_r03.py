"""What the findings of round 3 named."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from memloom.functions.entities import COMPOUNDS, frequencies, mentions, named
from memloom.functions.vectors import byte_histogram
from memloom.operators import drawers as dw
from memloom.operators import facts as kg
from memloom.operators.neighbours import best_of_block, bundled
from memloom.plans.queries import QUERIES
from memloom.sources import bundles
from memloom.sources.buckets import BucketTable, put_in
from memloom.streaming.refusals import Refusals


def test_texts_are_searched_once(spark, tmp_path):
    texts = [(1, "Zorvex met Quilla. Zorvex left; Quilla and Bram stayed."), (2, "nothing here"), (3, None)]
    spark.createDataFrame(texts, "k int, t string").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    common = spark.createDataFrame([("bram",)], "word string")
    once = rows.select(mentions(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    for found in (named(rows, "k", "t", common), named(rows, "k", "t", common, salient=True), frequencies(rows, "k", "t", common)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == once
    assert [tuple(r) for r in named(rows, "k", "t", common).collect()] == [(1, ["Quilla", "Zorvex"])]


def test_every_compound_is_found(spark):
    rows = spark.createDataFrame([(c, f"my {c.upper()}, his") for c in COMPOUNDS], "c string, t string")
    assert rows.where(~F.array_contains(mentions(F.col("t")), F.col("c"))).count() == 0


def test_many_questions_are_not_broadcast(spark, tmp_path):
    facts = spark.createDataFrame([("f", "Al", "likes", "Tea", "2024-01-01", "2024-02-01")], "id string, subject string, predicate string, object string, valid_from string, valid_to string")
    facts.write.parquet(str(tmp_path / "facts"))
    spark.createDataFrame([(1, "al", "2024-01-15")], "question_id int, entity string, as_of string").write.parquet(str(tmp_path / "asked"))
    found = kg.in_effect_for(spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "asked")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.select("question_id", "id").collect()] == [(1, "f")]


def test_histogram_of_bytes(spark):
    texts = ["", None, "abc", "\x00é\n日本߿😀" * 50, "A" * 70_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", byte_histogram(F.col("t")).alias("v"))
    want = [None if t is None else [sum(b % 32 == i for b in t.encode()) for i in range(32)] for t in texts]
    assert [r.v for r in rows.orderBy("k").collect()] == [w or [None] * 32 for w in want]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_ordered_bundle_of_any_size(spark, sf, monkeypatch):
    monkeypatch.setattr(bundles.ordered_bundle, "__defaults__", (1000,))  # as if the documents were larger than the bound
    last = spark.read.parquet(f"{sf}/documents.parquet").agg(F.max("doc_id")).first()[0] // 2
    got = QUERIES["s9_ordered_bundle"](spark, sf).first()
    assert (got.records, got.last_room, got.reason) == (last + 1, str(last), "not a record")


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(1000).select("id", F.lit("x").alias("v"))
        table = BucketTable.create(spark, str(tmp_path / "t"), rows.schema, ["id"], 2)
        table.merge("all", rows)
        assert sorted(tuple(r) for r in table.read().collect()) == [(i, "x") for i in range(1000)]
        assert len(list((tmp_path / "t" / "data" / "version=1" / "bucket=0").glob("*.parquet"))) > 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_contents_are_cut_once(spark, tmp_path):
    line = "Zorvex met Quilla at the mill. Zorvex and Quilla left the mill again.\n"
    docs = spark.createDataFrame([("t", "w", "r", "a.md", line * 60, "2024-01-01"), ("t", "w", "r", "b.md", "short", "2024-01-01")], "team_id string, wing string, room string, source_file string, content string, filed_at string")
    docs.write.parquet(str(tmp_path / "docs"))
    drawers, closets = dw.mine(spark.read.parquet(str(tmp_path / "docs")))
    for found in (drawers, closets):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("sequence(1, cast((CEIL") == 1
        assert [r.source_file for r in found.select("source_file").distinct().collect()] == ["a.md"]
    assert drawers.count() > 2


def test_values_of_new_facts_are_trimmed_once(spark, tmp_path):
    columns = "id string, subject string, predicate string, object string, valid_from string, valid_to string"
    spark.createDataFrame([("f", "Al", "likes", "Tea", "2024-01-01", ""), ("g", "Al", "had", "Tea", "2024-01-01", "2024-02-01")], columns).write.parquet(str(tmp_path / "facts"))
    new = [("x", " al", "likes ", "TEA", "2024-03-01", ""), ("x", "Al", "had", "Tea", "2024-05-01", ""), ("x", "Al ", "had", "Tea", " 2024-04-01", ""), ("x", "Al", "had", "Tea", "2024-04-02", "2024-04-01")]
    new += [("x", "Bo", "met", "Al", "2024-01-02", ""), ("x", "Bo", "met", "Al", "2024-01-02", "2024-01-05"), ("x", "Bo", "met", "Al", "2024-01-02", "2024-01-04"), ("x", "", "met", "Al", "2024-01-02", ""), ("x", "Bo", "met", "Al", None, "")]
    spark.createDataFrame(new, columns).write.parquet(str(tmp_path / "new"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    out = kg.add(facts, spark.read.parquet(str(tmp_path / "new")), "2024-03-01T00:00:00Z")
    got = {tuple(r) for r in out.select("subject", "predicate", "object", "valid_from", "valid_to").collect()} - {tuple(r) for r in facts.drop("id").collect()}
    assert got == {("Al ", "had", "Tea", "2024-04-01", ""), ("Bo", "met", "Al", "2024-01-02", "2024-01-04")}
    # five values of a new fact and three of a stored one, and the two bounds' ends
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 10


def test_teams_of_a_shard_are_worked_on_at_once():
    state, timers = {("a",): (2,)}, []
    shard = Refusals(3, ["team_id", "id", "ts"], None)
    shard.handle = SimpleNamespace(registerTimer=timers.append)
    shard.used = SimpleNamespace(getValue=state.get, updateValue=state.__setitem__)
    rows = [(t, i, 10 - i % 5, c) for i, (t, c) in enumerate([("a", 3), ("b", 2), (None, 1), ("free", 0)] * 6)]
    frame = pd.DataFrame(rows, columns=["team_id", "id", "ts", "cap"])
    got = pd.concat(shard.handleInputRows(("2024-01", 7), iter([frame[:7], frame[7:]]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    want = frame.sort_values(["ts", "id"]).assign(place=lambda f: f.groupby("team_id", dropna=False).cumcount())
    left = want["team_id"].map({"a": 1, "b": 2, "free": np.inf}).fillna(1)
    assert sorted(got["id"]) == list(range(24)) and list(got.columns) == ["team_id", "id", "ts", "admitted"]
    assert set(got["id"][got["admitted"]]) == set(want["id"][want["place"] < left])
    assert state == {("a",): (3,), ("b",): (2,), (None,): (1,), ("free",): (6,)} and len(timers) == 1


def block(name, vec, rows, dims=8):
    values = np.random.default_rng(rows).standard_normal(rows * dims).astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(0, rows * dims + 1, dims, dtype=np.int32), values)
    return pa.table({name: [f"{i:05d}" for i in range(rows)], vec: lists})


def test_memory_of_a_block_is_bounded():
    queries, vectors = block("query_id", "qvec", 1024), block("id", "vec", 16_384)
    best_of_block(queries[:1], vectors, 3)
    tracemalloc.start()
    found = best_of_block(queries, vectors, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 3072 and peak < 100_000_000  # all products are 134 MB


def test_a_block_gives_only_what_reaches_the_least_score():
    queries, vectors = block("query_id", "qvec", 50), block("id", "vec", 900)
    best = best_of_block(queries, vectors, 3).to_pandas()
    least = best.groupby("query_id")["score"].min().astype(np.float32)  # of ties with it none is lost
    again = best_of_block(queries.append_column("least", pa.array(least.to_numpy())), vectors, 3).to_pandas()
    assert again.equals(best)
    none = best_of_block(queries.append_column("least", pa.array(np.nextafter(best.groupby("query_id")["score"].max().to_numpy(), np.float32(2)))), vectors, 3)
    assert none.num_rows == 0
    assert bundled({-1: 5, 0: 16_000, 1: 300, 2: 300, 3: 99_999, 4: 1}) == {-1: -1, 0: -1, 1: -1, 2: 2, 3: 3, 4: 4}


def test_a_merge_deals_its_rows_once(spark, tmp_path):
    columns = "k long, j string, v string, at string, mark string"
    spark.createDataFrame([(1, None, "old", "1", "m"), (2, "a", "old", "1", "m"), (3, "a", "old", "1", None)], columns).write.parquet(str(tmp_path / "old"))
    spark.createDataFrame([(1, None, "late", "9"), (1, None, "zz", "2"), (3, "a", "new", "1"), (4, None, "new", "1")], "k long, j string, v string, at string").write.parquet(str(tmp_path / "new"))
    old, new = spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new"))
    got = put_in(old, new, ["k", "j"], {"place": F.pmod(F.xxhash64("k"), F.lit(3))}, ("mark",), ("at",))
    want = dw.keep_latest(old, new, ["k", "j"], ("mark",), ("at",))
    assert sorted(map(str, got.drop("place").collect())) == sorted(map(str, want.collect())) and got.count() == 4
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_keys_of_another_type_find_their_buckets(spark, tmp_path):
    rows = spark.range(50).select("id", F.lit("x").alias("v"))
    table = BucketTable.create(spark, str(tmp_path / "t"), rows.schema, ["id"], 16)
    table.merge("all", rows)
    table.merge("again", rows.where("id < 3").select(F.col("id").cast("int").alias("id"), F.lit("y").alias("v")))
    assert sorted(tuple(r) for r in table.read().collect()) == [(i, "y" if i < 3 else "x") for i in range(50)]
