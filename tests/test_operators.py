import json

import pytest
from pyspark.sql import functions as F

from memloom.operators import drawers as dw
from memloom.operators import facts as kg
from memloom.operators import graph, retrieval, tenancy
from memloom.sources import bundles, vectors
from memloom.sources.embedding import embedder
from memloom.streaming.ingest import admitted_batch, drained, merged, stream_bundles, versioned_merge

DRAWER = "team_id string, wing string, room string, source_file string, content string, filed_at string, content_date string"
FACT = "id string, subject string, predicate string, object string, valid_from string, valid_to string"


def drawers(spark, rows):
    return dw.add(spark.createDataFrame(rows, DRAWER))


def test_add_is_idempotent_and_replaces_sources(spark):
    old = drawers(spark, [("t", "w", "r", "s", "x" * 4000, "2024", ""), ("t", "w", "r", "", "free", "2024", "")])
    new = drawers(spark, [("t", "w", "r", "s", "short", "2025", "")])
    assert old.count() == 4
    assert sorted(r.content for r in dw.replace_sources(old, new).collect()) == ["free", "short"]
    assert dw.replace_sources(old, old).count() == 4


def test_traverse_takes_the_first_parent(spark):
    rows = [("t", w, r, "s", f"{w}{r}", "2024", "") for w, r in (("a", "x"), ("a", "y"), ("b", "y"), ("a", "z"), ("b", "z"), ("c", "z"), ("b", "v"), ("c", "v"))]
    got = [(r.room, r.hop, r.connected_via) for r in graph.traverse(drawers(spark, rows), "x", 3).collect()]
    assert got == [("x", 0, []), ("z", 1, ["a"]), ("y", 1, ["a"]), ("v", 2, ["b"])]
    with pytest.raises(ValueError):
        graph.traverse(drawers(spark, rows), "nowhere")


def test_hallways_keep_prior_figures(spark):
    rows = spark.createDataFrame([("w", "r1", ["B", "A"]), ("w", "r2", ["A", "B"]), ("w", "", ["A", "C"])], "wing string, room string, entities array<string>")
    first = graph.hallways(rows, now="n")
    assert [(r.entity_a, r.entity_b, r.together, r.rooms, r.label) for r in first.collect()] == [("A", "B", 2, ["r1", "r2"], "A ↔ B (co-occur in 2 drawers across 2 rooms: r1, r2)")]
    again = graph.hallways(rows, first.withColumn("strength", F.lit(5.0)), "later").first()
    assert (again.strength, again.last_active) == (5.0, "n")


def test_facts_are_inclusive_on_both_days(spark):
    facts = spark.createDataFrame([("1", "Alice", "works at", "Acme", "2024-01-01", "2025-06-01"), ("2", "Alice", "works at", "Globex", "2025-06-01", "")], FACT)
    at = lambda day: {r.object for r in kg.query(facts, "alice", day).collect()}
    assert (at("2023-01-01"), at("2024-06-01"), at("2025-06-01"), at("2025-12-01")) == (set(), {"Acme"}, {"Acme", "Globex"}, {"Globex"})
    new = spark.createDataFrame([("alice", "works_at", "globex", "2030-01-01", ""), ("Bob", "knows", "Eve", "2025-02-01", "2025-01-01"), ("Bob", "knows", "Al", "", "")], "subject string, predicate string, object string, valid_from string, valid_to string")
    assert sorted(r.object for r in kg.add(facts, new, "now").collect()) == ["Acme", "Al", "Globex"]
    assert [r.valid_to for r in kg.invalidate(facts, "Alice", "works at", "globex", "2026-01-01").orderBy("id").collect()] == ["2025-06-01", "2026-01-01"]
    with pytest.raises(Exception, match="before it starts"):
        kg.invalidate(facts, "Alice", "works at", "globex", "2020-01-01").collect()


def test_search_takes_the_pool_before_filters(spark):
    rows = drawers(spark, [("t", "w", "r", f"s{i}", f"text {i} redis" if i == 2 else f"text {i}", "2024", "") for i in range(4)])
    vec = spark.createDataFrame([(r.id, [1.0, float(r.source_file[1]) / 10]) for r in rows.collect()], "id string, vec array<float>").withColumn("namespace", F.lit("t"))
    hits = retrieval.search(vec, rows, "t", "redis", [1.0, 0.0], limit=1).collect()
    assert [h.source_file for h in hits] == ["s2"]
    assert retrieval.search(vec, rows, "t", "redis", [1.0, 0.0], limit=1, pool_multiple=1).first().source_file == "s0"
    assert retrieval.near_duplicate(vec, rows, "t", [1.0, 0.0]).first().is_duplicate


def test_admit_and_replays(spark):
    requests = spark.createDataFrame([("t", "2024-01", i) for i in range(4)], "team_id string, period string, at int")
    assert [r.admitted for r in tenancy.admit(requests, 3, ["at"]).orderBy("at").collect()] == [True, True, True, False]
    ops = [("a", "b", "w", i, 0, op) for i, op in enumerate(("request", "request", "accept", "reopen", "decline", "accept"))]
    row = tenancy.shares(spark.createDataFrame(ops, "from_team string, to_team string, wing string, at int, id int, op string")).first()
    assert (row.status, row.requests, row.accepted, row.declined) == ("declined", 1, 0, 1)
    jobs = [(1, i, 0, op, 7) for i, op in enumerate(("enqueue", "done", "claim", "release", "claim", "done"))]
    assert tuple(tenancy.job_states(spark.createDataFrame(jobs, "job_id int, at int, id int, op string, drawers long")).first()) == (1, "done", 7)


def test_mine_reaches_closets(spark):
    text = "---\ndate: 2024-11-08\n---\nWe built the cache with Redis and Postgres. Redis likes Postgres.\n" + "plain line of text here\n" * 20
    docs = spark.createDataFrame([("t", "w", "r", "notes.md", text, "2024-12-01T00:00:00Z"), ("t", "../x", "r", "bad", text, "2024")], "team_id string, wing string, room string, source_file string, content string, filed_at string")
    rows, closets = dw.mine(docs)
    first = rows.orderBy("chunk_index").first()
    assert (first.content_date, first.entities) == ("2024-11-08", ["Postgres", "Redis"])
    assert closets.first().document.startswith("built the cache with redis and postgres|Postgres;Redis|2024-11-08:L1-L")


def test_bundle_round_trip_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([("w", "r", "text")], "wing string, room string, content string")
    assert bundles.write_bundle(spark, str(tmp_path / "b"), drawer=rows, diary=rows) == 2
    with open(tmp_path / "b" / "extra.txt", "w") as f:
        f.write('{"kind": "unheard"}\nnot json\n')
    counts = {r.kind: r.records for r in bundles.counters(bundles.read_bundle(spark, str(tmp_path / "b"))).collect()}
    assert counts == {"manifest": 1, "drawer": 1, "diary": 1, "skipped": 2}
    users = spark.createDataFrame([("1", "a", "secret", "h"), ("2", "b", "secret", "h")], "id string, user_id string, password_hash string, token_hash string")
    kept = bundles.archive({"users": (users, "user"), "odd": (users, "what")}, "t", "a' or true --")
    assert kept["users"].count() == 0 and kept["odd"].count() == 0
    row = bundles.archive({"users": (users, "user")}, "t", "a")["users"].first()
    assert (row.password_hash, row.token_hash) == ("", "1")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("old", "new")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"kind": "drawer", "wing": "w", "room": "r", "content": text}) + "\n")
        stream_bundles(spark, str(tmp_path / "in"), str(tmp_path / "cp"), versioned_merge(str(tmp_path / "out"), ["wing", "room"])).awaitTermination()
    assert [r.content for r in merged(spark, str(tmp_path / "out"), ["wing", "room"]).collect()] == ["new"]


def test_embedder_checks_its_count(spark):
    ok, short = embedder(lambda texts: [[float(len(t))] for t in texts]), embedder(lambda texts: [])
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in rows.select(ok("t")).collect()] == [[2.0], [0.0]]
    with pytest.raises(Exception, match="another number"):
        rows.select(short("t")).collect()


def test_each_text_keeps_its_own_parent(spark):
    rows = drawers(spark, [("t", "w", "r", "", "a" * 4000, "2024", ""), ("t", "w", "r", "", "b" * 4000, "2024", ""), ("t", " w ", "r", "s", "c", "2024", "")]).collect()
    first = {r.content[0]: r.id for r in rows if r.chunk_index == 0}
    assert len(rows) == 7 and {r.wing for r in rows} == {"w"}
    assert all(r.parent_id == ("" if r.chunk_index == 0 else first[r.content[0]]) for r in rows)


def test_the_first_name_seen_names_an_entity(spark):
    facts = spark.createDataFrame([("2", "ZOE", "knows", "zoe", "", "", "b"), ("1", "Zoe", "knows", "Al", "", "", "a"), ("0", "al", "knows", "Bo", "", "", "c")], FACT + ", recorded_at string")
    assert {r.entity_id: r.name for r in kg.entities(facts).collect()} == {"zoe": "Zoe", "al": "Al", "bo": "Bo"}
    named = kg.with_names(spark.createDataFrame([("zoe", "nobody")], "subject_id string, object_id string"), kg.entities(facts)).first()
    assert (named.subject, named.object) == ("Zoe", "")


def test_deletes_say_whether_a_row_was_there(spark):
    rows = spark.createDataFrame([("1", "explicit"), ("2", "entity")], "id string, kind string")
    for id_, left, there in (("1", ["2"], True), ("9", ["1", "2"], False)):
        kept, existed = graph.delete_by_id(rows, id_)
        assert (sorted(r.id for r in kept.collect()), existed.first().existed) == (left, there)
    assert [r.id for r in graph.delete_kind(rows, "entity").collect()] == ["1"]


def test_closets_are_absorbed_once_and_copied_with_new_ids(spark):
    record = "team_id string, wing string, room string, source_file string, document string, entities array<string>, filed_at string"
    empty = spark.createDataFrame([], record + ", id string, embedded_at string")
    rows = spark.createDataFrame([("t", " w", "r", "s", "doc ", [], ""), ("t", "w", "r", "s", "doc ", [], "now"), ("t", "w", " ", "s", "doc", [], ""), ("t", "w", "r", "s", "  ", [], "")], record)
    once, taken = dw.absorb_closets(empty, rows, "now")
    again, _ = dw.absorb_closets(once.withColumn("embedded_at", F.lit("then")), rows, "now")
    assert taken.first().taken == 2
    assert [(r.document, r.filed_at, r.embedded_at) for r in again.collect()] == [("doc ", "now", "then")]
    vec = once.select(F.lit("t::closets").alias("namespace"), "id", F.array(F.lit(1.0)).alias("vec"))
    copied, vectors, counts = dw.copy_wing(once, vec, "t", "u", "w", closets=True)
    assert counts.first().asDict() == {"copied": 1, "skipped": 0}
    assert copied.first().id != once.first().id and vectors.first().namespace == "u::closets"


def test_pending_rows_of_every_team_are_embedded_oldest_first(spark):
    rows = spark.createDataFrame([(t, f"{t}{i}", f"202{i}", None if i else "then", "x") for t in "ab" for i in range(4)], "team_id string, id string, filed_at string, embedded_at string, content string")
    made, stamped = dw.embed_all_pending(rows, F.array(F.lit(1.0)), "now", 2)
    assert sorted(r.id for r in made.collect()) == ["a1", "a2", "b1", "b2"] and {r.embedded_at for r in stamped.collect()} == {"now"}


def test_chunkers_replace_columns_of_their_names(spark):
    from memloom.functions import text as tx

    rows = spark.createDataFrame([(1, 7, "old", "x" * 60)], "id int, chunk_index int, chunk string, text string")
    for cut in (tx.fixed_chunks, tx.stride_chunks, tx.boundary_chunks):
        got = cut(rows).first()
        assert (got.id, got.chunk_index, got.chunk) == (1, 0, "x" * 60)


def test_truth_is_written_before_the_index_and_syncs_prune(spark, tmp_path):
    rows = spark.createDataFrame([("n", "a", [3.0, 4.0]), ("m", "b", [0.0, 0.0])], "namespace string, id string, vec array<float>")
    truth, index = f"file://{tmp_path}/truth", f"file://{tmp_path}/index"
    vectors.write_truth_then_index(rows, truth, index)
    assert {r.id: [round(x, 6) for x in r.unit] for r in spark.read.parquet(index).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    done = vectors.sync(rows.where("id = 'a'").withColumn("id", F.lit("c")), index, recreate=True)
    assert [(r.namespace, r.failed) for r in done.collect()] == [("n", False)]
    assert sorted(r.id for r in spark.read.parquet(index).collect()) == ["b", "c"]


def test_members_come_and_go_with_their_keys(spark):
    users = spark.createDataFrame([("1", "A@x.org"), ("2", "b@x.org")], "user_id string, email string")
    none = spark.createDataFrame([], "team_id string, user_id string, role string, created_at string")
    one = tenancy.add_member(none, users, "t", " a@X.org ", "admin", "now")
    two = tenancy.add_member(one, users, "t", "b@x.org", "member", "now")
    for email, role in (("b@x.org", "member"), ("no@x.org", "member"), ("a@x.org", "king")):
        with pytest.raises(ValueError):
            tenancy.add_member(two, users, "t", email, role, "now")
    keys = spark.createDataFrame([("t", "2", "k1", None), ("t", "2", "k2", "old"), ("t", "1", "k3", None), ("u", "2", "k4", None)], "team_id string, user_id string, id string, revoked_at string")
    left, revoked = tenancy.remove_member(two, keys, "t", "2", "now")
    assert [r.user_id for r in left.collect()] == ["1"]
    assert {r.id: r.revoked_at for r in revoked.collect()} == {"k1": "now", "k2": "old", "k3": None, "k4": None}
    with pytest.raises(ValueError):
        tenancy.remove_member(left, keys, "t", "1", "now")


def test_pending_rows_are_drained_oldest_first(spark):
    state = {"rows": spark.createDataFrame([("t", f"{i}", f"202{i}", None) for i in range(5)], "team_id string, id string, filed_at string, embedded_at string"), "order": []}

    def save(made, stamped):
        state["order"].append(sorted(r.id for r in made.collect()))
        state["rows"] = spark.createDataFrame(dw.keep_latest(state["rows"], stamped, ["team_id", "id"]).collect(), state["rows"].schema)

    assert drained(lambda: state["rows"], save, F.array(F.lit(1.0)), "now", 2) == 3
    assert state["order"] == [["0", "1"], ["2", "3"], ["4"]]
    marked, used = admitted_batch(spark.createDataFrame([("t", "p", i, i) for i in range(3)], "team_id string, period string, ts int, id int"), spark.createDataFrame([("t", "p", 1)], "team_id string, period string, used long"), 2)
    assert [r.admitted for r in marked.orderBy("id").collect()] == [True, False, False] and used.first().used == 2


def test_mining_again_replaces_only_what_passes(spark):
    schema = "team_id string, wing string, room string, source_file string, content string, filed_at string"
    text = "Redis and Postgres are used here. Redis likes Postgres very much indeed.\n"
    rows, closets = dw.mine(spark.createDataFrame([("t", " w ", "", " a.md ", text, "2024"), ("t", "w", "r", "b.md", text * 90, "2024"), ("t", "w", "r", "c.md", text, "2024")], schema))
    assert {(r.wing, r.room, r.source_file) for r in rows.collect()} == {("w", "general", "a.md"), ("w", "r", "b.md"), ("w", "r", "c.md")}
    first = {r.id for r in rows.where("source_file = 'b.md' and chunk_index = 0").collect()}
    assert {r.parent_id for r in rows.where("source_file = 'b.md' and chunk_index > 0").collect()} == first and rows.where("source_file = 'b.md'").count() > 2
    again = [("t", "w", "r", "b.md", "x" * 100_001, "2025"), ("t", "w", "general", "a.md", "short", "2025"), ("t", "w", "r", "c.md", text.replace("very", "so"), "2025"), ("t", "v", "r", "c.md", text.replace("very", "too"), "2026")]
    new_rows, new_closets = dw.mined_into(rows, closets, spark.createDataFrame(again, schema))
    assert new_rows.where("source_file = 'b.md'").count() == rows.where("source_file = 'b.md'").count() and new_closets.where("source_file = 'b.md'").count() == 1
    assert new_rows.where("source_file = 'a.md'").count() == new_closets.where("source_file = 'a.md'").count() == 0
    assert {(r.wing, "so" in r.content, "too" in r.content) for r in new_rows.where("source_file = 'c.md'").collect()} == {("w", True, False), ("v", False, True)}
    assert [r.wing for r in new_closets.where("source_file = 'c.md'").collect()] == ["v"]


def test_ended_facts_all_stay_and_one_current(spark):
    facts = spark.createDataFrame([("i", "Al", "likes", "Tea", "2019-01-01", "2019-06-01")], "id string, subject string, predicate string, object string, valid_from string, valid_to string")
    new = [("Al", "likes", "Tea", "2020-01-01", "2021-01-01"), (" al ", "Likes", "tea", "2021-02-01", "2021-03-01"), ("Al", "likes", "Tea", "2022-01-01", ""), ("Al", "likes", "Tea", "2023-01-01", ""), ("Al", "likes", "Tea", "2020-01-01", "2020-05-01")]
    got = kg.add(facts, spark.createDataFrame(new, "subject string, predicate string, object string, valid_from string, valid_to string"), "now")
    assert sorted((r.valid_from, r.valid_to) for r in got.collect()) == [("2019-01-01", "2019-06-01"), ("2020-01-01", "2020-05-01"), ("2021-02-01", "2021-03-01"), ("2022-01-01", "")]
    assert kg.add(got, spark.createDataFrame(new[:3], "subject string, predicate string, object string, valid_from string, valid_to string"), "later").count() == 4


def test_unequal_repeats_have_one_outcome(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, "b"), ("c", 1, "z"), ("c", 1, "zz")], "k string, n int, v string")
    for rows in (new, new.orderBy("v"), new.orderBy(new.v.desc()).repartition(3)):
        assert sorted(map(tuple, dw.keep_latest(old, rows, ["k"], order=("n",)).collect())) == [("a", 3, "b"), ("c", 1, "zz")]
