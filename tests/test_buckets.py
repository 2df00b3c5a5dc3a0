"""Tables by buckets against plain merges."""

import random

import pytest

from memloom.operators.drawers import keep_latest
from memloom.sources.buckets import BucketTable
from memloom.streaming.ingest import stream_bundles

SCHEMA = "team string, id string, n int, v array<float>, embedded_at string"


def rows_of(spark, rng, n):
    return spark.createDataFrame([(rng.choice(("t0", "t1", None)), f"k{rng.randrange(300)}", rng.randrange(1000), [float(rng.randrange(9))], None) for _ in range(n)], SCHEMA)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_random_changes_equal_plain_merges(spark, tmp_path):
    rng = random.Random(4)
    first = rows_of(spark, rng, 250)
    table = BucketTable.create(spark, str(tmp_path / "t"), first.schema, ["team", "id"], buckets=16)
    assert table.read().count() == 0
    plain, states = spark.createDataFrame([], SCHEMA), {}
    for k in range(5):
        rows = rows_of(spark, rng, (200, 3, 0, 40, 1)[k])
        plain = spark.createDataFrame(keep_latest(plain, rows, ["team", "id"], keep=("embedded_at",), order=("n",)).collect(), SCHEMA)
        version = table.merge(f"b{k}", rows, keep=("embedded_at",), order=("n",))
        states[version] = plain
        assert same(table.read(), plain) and table.merge(f"b{k}", rows_of(spark, rng, 9)) == version and same(table.read(), plain)
        hit = table.commit_of(version)["rewritten"]
        assert len(hit) <= rows.select("team", "id").distinct().count() and hit == [b for b, v in sorted((int(b), v) for b, v in table.commit_of(version)["held"].items()) if v == version]
    gone = plain.limit(30)
    table.delete("gone", gone)
    left = plain.exceptAll(gone)
    assert same(BucketTable(spark, table.path).read(), left)
    assert all(same(table.read(v), rows) for v, rows in states.items())
    table.delete("all", table.read())
    assert table.read().count() == 0 and table.commit_of(table.versions()[-1])["held"] == {}


def test_one_row_rewrites_one_bucket_and_a_lost_commit_is_not_seen(spark, tmp_path):
    rng = random.Random(5)
    table = BucketTable.create(spark, str(tmp_path / "t"), rows_of(spark, rng, 1).schema, ["team", "id"], buckets=16)
    table.merge("a", rows_of(spark, rng, 200))
    before = table.read()
    files = set(before.inputFiles())
    one = before.limit(1)
    version = table.merge("b", one)
    assert len(table.commit_of(version)["rewritten"]) == 1 and len(set(table.read().inputFiles()) - files) == 1
    # files without their commit, as of a writer that was lost
    one.write.parquet(f"{table.path}/data/version={version + 1}/bucket=3")
    count = table.read().count()
    assert BucketTable(spark, table.path).read().count() == count == before.count()
    assert table.merge("c", one) == version + 1 and table.read().count() == count
    with pytest.raises(Exception, match="already exists"):
        BucketTable.create(spark, table.path, before.schema, ["id"])


def test_a_stream_merges_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "wing string, room string, content string"
    table = BucketTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["wing", "room"], buckets=4)
    merge = table.merge_stream("bundles")
    for i, text in enumerate(("old", "new")):
        (tmp_path / "in" / f"{i}.json").write_text('{"kind": "drawer", "wing": "w", "room": "r", "content": "%s"}\n' % text)
        stream_bundles(spark, str(tmp_path / "in"), str(tmp_path / "cp"), merge).awaitTermination()
    assert [r.content for r in table.read().collect()] == ["new"] and table.versions() == [1, 2]
    merge(spark.createDataFrame([("w", "r", "again")], schema), 1)
    assert [r.content for r in table.read().collect()] == ["new"] and table.versions() == [1, 2]
