"""The index of cells and the neighbour join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions.vectors import cosine
from memloom.operators import neighbours, retrieval
from memloom.operators.neighbours import CellIndex, nearest_join


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8))
    rows = [(f"team-{i % 2}", f"v{i:04d}", (centres[i % 12] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(600)]
    rows += [("team-0", f"same{i:03d}", rows[5][2]) for i in range(120)]  # many ties
    rows += [("team-0", "zero", [0.0] * 8), ("team-1", "zero1", [0.0] * 8), ("team-0", "short", [1.0, 2.0])]
    return spark.createDataFrame(rows, "namespace string, id string, vec array<float>").cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return CellIndex.build(vectors, str(tmp_path_factory.mktemp("cells") / "i"), cells=9)


def queries(spark, vectors):
    rng = np.random.default_rng(7)
    rows = [(str(i), rng.standard_normal(8).astype(np.float32).tolist()) for i in range(40)] + [("zero", [0.0] * 8), ("short", [2.0, 1.0]), ("none", [])]
    own = vectors.where("id in ('v0005', 'same003', 'v0100')").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return spark.createDataFrame(rows, "query_id string, qvec array<float>").unionByName(own)


def by_all_pairs(asked, vectors, k, namespace=None):
    rows = vectors.where(F.col("namespace") == namespace) if namespace else vectors
    scored = asked.crossJoin(rows).select("query_id", "id", cosine(F.col("vec"), F.col("qvec")).alias("score"))
    out = {}
    for r in scored.collect():
        out.setdefault(r.query_id, []).append((-r.score, r.id))
    return {(q, i, -s, n + 1) for q, found in out.items() for n, (s, i) in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize(("k", "namespace"), [(1, None), (4, "team-0"), (130, "team-0"), (700, "team-1")])
def test_join_equals_all_pairs(spark, vectors, index, k, namespace, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 16)
    asked = queries(spark, vectors)
    got = nearest_join(asked, index, k, namespace)
    assert {tuple(r) for r in got.collect()} == by_all_pairs(asked, vectors, k, namespace)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_equals_all_vectors_and_reads_few_cells(spark, vectors, index):
    again = CellIndex.open(spark, index.path)
    for i, query in enumerate((vectors.first().vec, [0.5] * 8, [0.0] * 8, [1.0, 1.0], [-3.0, 1, 2, 0, 0, 1, 5, -1])):
        for k in (0, 1, 5, 130, 1000):
            want = retrieval.nearest(vectors, "team-0", query, k).collect()
            assert again.nearest("team-0", query, k).collect() == want, (i, k)
            assert retrieval.nearest(again, "team-0", query, k).collect() == want
    probed = again.nearest("team-0", vectors.first().vec, 3, probes=2)
    read = {f.split("/cell=")[1].split("/")[0] for f in again.cells("team-0", [0, 1]).inputFiles()}
    assert probed.count() == 3 and "PartitionFilters" in probed._jdf.queryExecution().toString() and len(read) >= 2
    assert again.nearest("nobody", [1.0] * 8, 3).count() == 0


def test_recall_of_probes(spark, vectors, index):
    asked = queries(spark, vectors).where("query_id in ('0', '1', '2', '3', '4', '5', 'v0100')")
    exact, probed = ({(r.query_id, r.id) for r in nearest_join(asked, index, 10, "team-1", probes).collect()} for probes in (None, 4))
    assert len(probed & exact) >= 0.9 * len(exact)


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "namespace string, id string, vec array<float>")
    index = CellIndex.build(none, str(tmp_path / "i"))
    assert index.nearest("t", [1.0], 3).count() == 0 and CellIndex.open(spark, index.path).nearest("t", [1.0], 3).count() == 0
    assert nearest_join(spark.createDataFrame([("q", [1.0])], "query_id string, qvec array<float>"), index).count() == 0


def test_best_for_each_keeps_the_type_of_its_queries(spark, vectors):
    asked = spark.createDataFrame([(7, [1.0] * 8)], "query_id long, qvec array<float>")
    row = retrieval.nearest_for_each(asked, vectors).first()
    assert row.query_id == 7 and row.id == retrieval.nearest(vectors.withColumn("namespace", F.lit("t")), "t", [1.0] * 8, 1).first().id
