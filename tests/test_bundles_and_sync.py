"""Bundles read in order up to what is wrong, and an index synced by digests."""

import random

import pytest

from memloom.sources import bundles, vectors
from memloom.sources.buckets import BucketTable


def written(folder, files):
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def record(k):
    return '{"kind": "drawer", "wing": "w", "room": "r%d", "content": "%s"}' % (k, "x" * (k % 50))


def rooms(rows):
    return sorted(int(r.room[1:]) for r in rows.collect() if r.room)


def test_what_lies_before_the_first_bad_line_is_kept(spark, tmp_path):
    files = {f"part-{n}.json": [record(n * 1000 + k) for k in range(1000)] for n in range(4)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows, report = bundles.ordered_bundle(spark, written(tmp_path / "good", files))
        row = report.first()
        assert rows.rdd.getNumPartitions() > 8 and rooms(rows) == list(range(4000)) and (row.records, row.reason) == (4000, None)
        for bad in ("not json", '{"kind": "drawer", ', "[1]", "7"):
            broken = {n: list(v) for n, v in files.items()}
            broken["part-3.json"].insert(10, "also bad")
            broken["part-2.json"].insert(637, bad)
            broken["part-1.json"].insert(5, "   ")
            broken["part-0.json"].append('{"kind": "unheard"}')
            rows, report = bundles.ordered_bundle(spark, written(tmp_path / f"bad{len(bad)}", broken))
            row = report.first()
            assert rooms(rows) == list(range(2637)) and (row.records, row.bad_line, row.reason) == (2638, bad, "not a record") and row.bad_file.endswith("part-2.json")
            assert bundles.counters(rows).where("kind = 'skipped'").first().records == 1
        bound = sum(len(x) + 1 for x in files["part-0.json"] + files["part-1.json"][:400])
        for more, kept in ((0, 1400), (1, 1400), (-1, 1399)):
            rows, report = bundles.ordered_bundle(spark, str(tmp_path / "good"), bound + more)
            assert rooms(rows) == list(range(kept)) and report.first().reason == "too many bytes"
        rows, report = bundles.ordered_bundle(spark, str(tmp_path / "bad8"), bound + 10**6)
        assert report.first().reason == "not a record"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.json").write_text("")
    rows, report = bundles.ordered_bundle(spark, str(tmp_path / "none"))
    assert rows.count() == 0 and report.first().records == 0


def test_sync_writes_only_what_differs(spark, tmp_path):
    rng = random.Random(3)
    schema = "namespace string, id string, vec array<float>"
    truth = {(f"n{i % 3}", f"v{i}"): [rng.random(), rng.random()] for i in range(200)}
    frame = lambda: spark.createDataFrame([(*k, v) for k, v in truth.items()], schema)
    index = vectors.index_table(spark, str(tmp_path / "i"), buckets=16)
    first = {r.namespace: (r.put, r.gone) for r in vectors.sync_by_digests(frame(), index, "a").collect()}
    assert sum(p for p, _ in first.values()) == 200 and not any(g for _, g in first.values())
    assert vectors.sync_by_digests(frame(), index, "b").count() == 0 and index.commit_of(2)["rewritten"] == []
    truth["n0", "v0"] = [5.0, 1.0]
    gone = truth.pop(("n1", "v1"))
    assert {tuple(r) for r in vectors.sync_by_digests(frame(), index, "c").collect()} == {("n0", 1, 0)} and len(index.commit_of(3)["rewritten"]) == 1
    assert {tuple(r) for r in vectors.sync_by_digests(frame(), index, "d", recreate=True).collect()} == {("n1", 0, 1)} and gone
    want = vectors.unit_index(frame())
    assert sorted(map(repr, index.read().collect())) == sorted(map(repr, want.select("namespace", "id", "unit").collect()))


def test_an_archive_is_of_one_version_and_checked(spark, tmp_path):
    users = spark.createDataFrame([("u1", "a@x", "hash1", "tok"), ("u2", "b@x", "hash2", "tok")], "id string, email string, password_hash string, token_hash string")
    notes = spark.createDataFrame([("t", "n1"), ("t", "n2"), ("other", "n3")], "team_id string, id string")
    tables = {"users": (BucketTable.create(spark, str(tmp_path / "users"), users.schema, ["id"], 4), "user_row"), "notes": (BucketTable.create(spark, str(tmp_path / "notes"), notes.schema, ["id"], 4), "team"), "empty": (BucketTable.create(spark, str(tmp_path / "empty"), notes.schema, ["id"], 4), "team")}
    tables["users"][0].merge("a", users)
    tables["notes"][0].merge("a", notes)
    at = bundles.versions_of(tables)
    tables["notes"][0].merge("b", spark.createDataFrame([("t", "late")], notes.schema))  # between two tables
    manifest = bundles.write_archive(tables, "t", "u1", str(tmp_path / "archive"), at)
    assert {(r.name, r.version, r.rows) for r in manifest.collect()} == {("users", 1, 1), ("notes", 1, 2), ("empty", 0, 0)}
    parts = bundles.read_archive(spark, str(tmp_path / "archive"))
    assert [tuple(r) for r in parts["users"].collect()] == [("u1", "a@x", "", "u1")] and sorted(r.id for r in parts["notes"].collect()) == ["n1", "n2"]
    spark.createDataFrame([("t", "n1"), ("t", "n9")], notes.schema).write.mode("overwrite").parquet(str(tmp_path / "archive" / "notes"))
    with pytest.raises(ValueError, match="notes"):
        bundles.read_archive(spark, str(tmp_path / "archive"))
