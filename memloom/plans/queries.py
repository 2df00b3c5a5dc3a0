"""The registered queries and, where SQL can express them over whole tables, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import ids
from memloom.functions import text as tx
from memloom.functions.entities import STOP_WORDS, frequencies, named
from memloom.functions.pointers import locator, packed, pointer_lines
from memloom.functions.vectors import byte_histogram, distance, similarity
from memloom.operators import drawers as dw
from memloom.operators import facts as kg
from memloom.operators import graph, imports, retrieval, taxonomy, tenancy
from memloom.operators.neighbours import CellIndex, nearest_join
from memloom.plans.views import read, view, with_views
from memloom.sources import bundles, vectors
from memloom.sources.buckets import BucketTable
from memloom.sources.shared import kept, scratch
from memloom.streaming.ingest import admitted_batch, metered, windowed
from memloom.streaming.refusals import run_refusals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TEAM, CAP, NOW = "team-0", 50, "2024-03-01T00:00:00Z"


COSINE = "(list_dot_product(v.vec::double[], q.q::double[]) / (sqrt(list_dot_product(v.vec::double[], v.vec::double[])) * sqrt(list_dot_product(q.q::double[], q.q::double[]))))::float"
QUERY = "q as (select embedding as q from embeddings order by vec_id limit 1)"


#: A whole vector as text, in millionths.
VEC = "array_to_string(list_transform(vec, lambda x: round(x::double * 1000000)::bigint), ',')"


def vec_text(vec: Column) -> Column:
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 1_000_000).cast("long")), ",")


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return query

    return add


def team(spark: SparkSession, d: str, name: str = "drawers") -> DataFrame:
    rows = view(spark, d, name)
    return rows.where(F.col("team_id" if "team_id" in rows.columns else "namespace") == TEAM)


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """One row: the vector of the first embedding."""
    return read(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


# --- taxonomy and lists ---


@register("a1_wings", "select wing, count(*) as drawers, count(distinct room) as rooms from drawers group by wing", ("drawers",))
def _(s, d):
    return taxonomy.wings(view(s, d, "drawers"))


@register("a2_rooms", "select wing, room, count(*) as drawers from drawers group by wing, room", ("drawers",))
def _(s, d):
    return taxonomy.rooms(view(s, d, "drawers"))


@register("a3_tree", "select wing, sum(n)::bigint as drawers, string_agg(room || ':' || n, ',' order by room || ':' || n) as rooms from (select wing, room, count(*) as n from drawers group by wing, room) group by wing", ("drawers",))
def _(s, d):
    return taxonomy.tree(view(s, d, "drawers"))


@register("a4_filed_away", "select count(*) as drawers, coalesce(max(filed_at), '') as last_filed_at, count(distinct wing) as wings, count(distinct room) as rooms from drawers", ("drawers",))
def _(s, d):
    return taxonomy.filed_away(view(s, d, "drawers"))


@register("a5_room_wings", "select room, wing, count(*) as drawers, max(content_date) as recent from drawers where wing <> '' and room <> '' and room <> 'general' group by room, wing", ("drawers",))
def _(s, d):
    return graph.room_wings(view(s, d, "drawers"))


NODES = "select room, list_sort(list(distinct wing)) as wings, count(*) as drawers, max(content_date) as recent from drawers where wing <> '' and room <> '' and room <> 'general' group by room"


@register("a6_graph_nodes", NODES, ("drawers",))
def _(s, d):
    return graph.nodes(view(s, d, "drawers"))


@register("a9_fact_stats", """with names as (select subject as n from facts union all select object from facts) select (select count(distinct replace(replace(lower(n), ' ', '_'), '''', '')) from names) as entities,
    count(*) as facts, count(*) filter (where valid_to = '') as current, count(*) filter (where valid_to <> '') as expired, string_agg(distinct predicate, ',' order by predicate) as predicates from facts""", ("facts",))
def _(s, d):
    return kg.stats(view(s, d, "facts"))


def embedded(s: SparkSession, d: str) -> DataFrame:
    """Drawers with embedded_at: null where no vector is there."""
    have = view(s, d, "vectors").select("id", F.lit(NOW).alias("embedded_at"))
    return view(s, d, "drawers").join(have, "id", "left")


PENDING = "select team_id, count(*) as pending from drawers where id not in (select id from vectors) group by team_id"


@register("a10_pending", PENDING, ("drawers", "vectors"))
def _(s, d):
    return taxonomy.pending(embedded(s, d))


@register("a10_teams_pending", f"select team_id from ({PENDING})", ("drawers", "vectors"))
def _(s, d):
    rows = embedded(s, d)
    return taxonomy.teams_with_pending(rows, rows)


@register("a10_oldest_pending", f"select id, filed_at from drawers where team_id = '{TEAM}' and id not in (select id from vectors) order by filed_at, id limit 64", ("drawers", "vectors"))
def _(s, d):
    return taxonomy.oldest_pending(embedded(s, d), TEAM).select("id", "filed_at")


@register("a11_journal_total", "select agent, count(*) as total from journal group by agent", ("journal",))
def _(s, d):
    return view(s, d, "journal").groupBy("agent").agg(F.count("*").alias("total"))


@register("a12_usage", f"select team_id, period, least(count(*), {CAP}) as used, {CAP} - least(count(*), {CAP}) as remaining from requests group by team_id, period", ("requests",))
def _(s, d):
    return taxonomy.usage(view(s, d, "requests"), CAP)


@register("a13_admins", "select 'nation-' || c_nationkey as team_id, count(*) filter (where c_mktsegment = 'BUILDING') as admins from customer group by c_nationkey")
def _(s, d):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member")
    return taxonomy.admins(read(s, d, "customer").select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("team_id"), role.alias("role")))


@register("a15_status", "select d.team_id, d.drawers, d.wings, coalesce(u.used, 0)::bigint as used from (select team_id, count(*) as drawers, count(distinct wing) as wings from drawers group by team_id) d left join (select team_id, count(*) as used from requests group by team_id) u using (team_id)", ("drawers", "requests"))
def _(s, d):
    return taxonomy.status(view(s, d, "drawers"), taxonomy.usage(view(s, d, "requests"), 0))


@register("s1_lookup", "select id, wing, room from drawers where id = (select min(id) from drawers)", ("drawers",))
def _(s, d):
    rows = view(s, d, "drawers")
    return rows.join(F.broadcast(rows.agg(F.min("id").alias("id"))), "id", "left_semi").select("id", "wing", "room")


@register("s2_batch_lookup", "select id, wing from drawers where id in (select id from vectors)", ("drawers", "vectors"))
def _(s, d):
    return dw.by_ids(view(s, d, "drawers"), view(s, d, "vectors")).select("id", "wing")


@register("s3_page", f"select id, filed_at from drawers where team_id = '{TEAM}' order by filed_at desc, id limit 50 offset 50", ("drawers",))
def _(s, d):
    return dw.page(team(s, d), limit=50, offset=50).select("id", "filed_at")


@register("s4_by_source", "select id from drawers where source_file = 'src/doc-7.md'", ("drawers",))
def _(s, d):
    return view(s, d, "drawers").where("source_file = 'src/doc-7.md'").select("id")


@register("s5_points", f"select id, {VEC} as vec, len(vec) as dims from vectors where namespace = '{TEAM}'", ("vectors",))
def _(s, d):
    return vectors.points(view(s, d, "vectors"), TEAM).select("id", vec_text(F.col("vec")).alias("vec"), F.size("vec").cast("long").alias("dims"))


@register("s6_points_by_id", f"select id, {VEC} as vec, len(vec) as dims from vectors where namespace = '{TEAM}' and id in (select id from drawers where room = 'general')", ("vectors", "drawers"))
def _(s, d):
    return vectors.points(view(s, d, "vectors"), TEAM, view(s, d, "drawers").where("room = 'general'")).select("id", vec_text(F.col("vec")).alias("vec"), F.size("vec").cast("long").alias("dims"))


@register("s7_namespaces", "select distinct namespace from vectors", ("vectors",))
def _(s, d):
    return vectors.namespaces(view(s, d, "vectors"))


@register("s11_named_facts", "select subject, predicate, object, valid_from, valid_to from facts", ("facts",))
def _(s, d):
    rows = view(s, d, "facts")
    names = kg.entities(rows)
    return bundles.named_facts(rows.select(ids.entity_id(F.col("subject")).alias("subject_id"), "predicate", ids.entity_id(F.col("object")).alias("object_id"), "valid_from", "valid_to"), names)


@register("s13_archive", f"select 'drawers' as tbl, id from drawers where team_id = '{TEAM}' union all select 'vectors', id from vectors where namespace = '{TEAM}' or namespace like '{TEAM}::%' union all select 'users', c_custkey || ':' || '' from customer where c_custkey = 1 union all select 'api_keys', c_custkey || ':' || c_custkey || ':' from customer where c_nationkey = 1 and c_custkey = 1 union all select 'plans', n_nationkey::varchar from nation", ("drawers", "vectors"))
def _(s, d):
    people = read(s, d, "customer").withColumns({"id": F.col("c_custkey").cast("string"), "user_id": F.col("c_custkey").cast("string"), "team_id": F.when(F.col("c_nationkey") == 1, TEAM).otherwise("other")})
    tables = {
        "drawers": view(s, d, "drawers"), "vectors": view(s, d, "vectors"), "plans": read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id")),
        "users": people.select("id", F.lit("secret").alias("password_hash")), "api_keys": people.select("id", "user_id", "team_id", F.lit("h").alias("token_hash"), F.lit("e").alias("token_enc")), "unlisted": view(s, d, "facts"),
    }
    parts = bundles.tenant_archive(tables, TEAM, "1")
    shown = {"users": F.concat_ws(":", "id", "password_hash"), "api_keys": F.concat_ws(":", "id", "token_hash", "token_enc")}
    rows = [part.select(F.lit(name).alias("tbl"), shown.get(name, F.col("id")).alias("id")) for name, part in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@register("s14_upsert", "select id, case when vec_id % 2 = 0 then 1.0 else embedding[1] end::float as first from (select v.id, v.doc_id as vec_id, v.vec as embedding from vectors v) where vec_id % 7 <> 0", ("vectors",))
def _(s, d):
    rows = view(s, d, "vectors").select("namespace", "id", "vec", "doc_id")
    new = rows.where("doc_id % 2 = 0").withColumn("vec", F.transform("vec", lambda v: F.lit(1.0).cast("float")))
    kept = vectors.delete(vectors.upsert(rows, new), rows.where("doc_id % 7 = 0"))
    return kept.select("id", F.get("vec", F.lit(0)).alias("first"))


@register("s14_bucket_merge", f"select id, case when doc_id % 2 = 0 then '1000000' else {VEC} end as vec, doc_id from vectors where doc_id % 7 <> 0", ("vectors",))
def _(s, d):
    """The same as commits to a table by buckets, which come twice, and are read again from its folder."""
    rows = view(s, d, "vectors").select("namespace", "id", "vec", "doc_id")
    table = BucketTable.create(s, scratch(s, "vectors"), rows.schema, ["namespace", "id"], buckets=16)
    for _again in range(2):
        table.merge("all", rows)
        table.merge("even", rows.where("doc_id % 2 = 0").withColumn("vec", F.array(F.lit(1.0).cast("float"))))
        table.delete("sevenths", rows.where("doc_id % 7 = 0"))
    return BucketTable(s, table.path).read().select("id", vec_text(F.col("vec")).alias("vec"), "doc_id")


@register("s15_unit_index", "select id, round(sqrt(list_sum(list_transform(vec, lambda x: x::double * x::double))), 6) as norm from vectors", ("vectors",))
def _(s, d):
    rows = view(s, d, "vectors").join(vectors.unit_index(view(s, d, "vectors")), ["namespace", "id"])
    size = F.aggregate(F.zip_with("vec", "unit", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.round(size, 6).alias("norm"))


@register("s15_nearest_units", f"with {QUERY} select id, round(score, 5) as score from (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}') order by score desc, id limit 20", ("vectors",))
def _(s, d):
    """The neighbours that the index gives are those of the truth."""
    return retrieval.nearest_units(vectors.unit_index(view(s, d, "vectors")), TEAM, query_vector(s, d), 20).select("id", F.round("score", 5).alias("score"))


@register("s13_versioned_archive", f"select 'drawers' as tbl, id, content from drawers where team_id = '{TEAM}' union all select 'vectors', id, '' from vectors where namespace = '{TEAM}'", ("drawers", "vectors"))
def _(s, d):
    """An archive of two stored tables as of versions that later writes don't show in, read back against its manifest."""
    rows, points = view(s, d, "drawers").select("team_id", "id", "content"), view(s, d, "vectors").select("namespace", "id", "vec")
    tables = {"drawers": (BucketTable.create(s, scratch(s, "drawers"), rows.schema, ["team_id", "id"], 8), "team"), "vectors": (BucketTable.create(s, scratch(s, "vectors"), points.schema, ["namespace", "id"], 8), "namespace")}
    tables["drawers"][0].merge("all", rows)
    tables["vectors"][0].merge("all", points)
    at = bundles.versions_of(tables)
    tables["vectors"][0].delete("later", points.where(F.substring("id", 1, 1) < "8"))
    folder = scratch(s, "archive")
    bundles.write_archive(tables, TEAM, "user", folder, at)
    read_ = bundles.read_archive(s, folder)
    return read_["drawers"].select(F.lit("drawers").alias("tbl"), "id", "content").unionByName(read_["vectors"].select(F.lit("vectors").alias("tbl"), "id", F.lit("").alias("content")))


@register("s17_synced_index", "select id, round(sqrt(list_sum(list_transform(vec, lambda x: x::double * x::double))), 6) as norm from vectors", ("vectors",))
def _(s, d):
    """An index that lacks some vectors, has others wrong and some that went, after one sync over all namespaces."""
    rows = view(s, d, "vectors")
    index = vectors.index_table(s, scratch(s, "index"), buckets=16)
    stale = rows.where("doc_id % 4 <> 0").withColumn("vec", F.when(F.col("doc_id") % 4 == 1, F.transform("vec", lambda v: v + 1)).otherwise(F.col("vec")))
    vectors.sync_by_digests(stale.unionByName(rows.where("doc_id % 4 = 3").withColumn("id", F.concat(F.lit("old-"), "id"))), index, "before")
    vectors.sync_by_digests(rows, index, "now", recreate=True)
    both = index.read().join(rows, ["namespace", "id"], "left")
    return both.select("id", F.round(F.aggregate(F.zip_with("vec", "unit", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x), 6).alias("norm"))


@register("s9_ordered_bundle", "select count(*) filter (where doc_id <= last) as records, string_agg(distinct case when doc_id <= last then 'drawer' end, ',') as kinds, max(doc_id) filter (where doc_id <= last)::varchar as last_room, 'not a record' as reason from documents, (select max(doc_id) // 2 as last from documents)")
def _(s, d):
    """A bundle of all documents in order of doc_id, in several files, with a line in the middle that is no record: what lies before it."""
    rows = read(s, d, "documents").select("doc_id", F.to_json(F.struct(F.lit("drawer").alias("kind"), F.col("lang").alias("wing"), F.col("doc_id").cast("string").alias("room"), F.col("text").alias("content"))).alias("line"))
    middle = rows.agg(F.max("doc_id")).first()[0] // 2
    broken = rows.unionByName(rows.where(F.col("doc_id") == middle + 1).select("doc_id", F.lit('{"kind": "drawer", ').alias("line"))).withColumn("bad", (F.col("line") != '{"kind": "drawer", ').cast("int"))
    folder = scratch(s, "bundle")
    broken.repartitionByRange(4, "doc_id", "bad").sortWithinPartitions("doc_id", "bad").select("line").write.text(folder)
    taken, report = bundles.ordered_bundle(s, folder, None)
    found = taken.agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max(F.col("room").cast("long")).cast("string").alias("last_room"))
    return found.crossJoin(report.select("reason"))  # one row each


@register("w21_removed_member", "select c_custkey as key_id, case when c_custkey % 5 = 2 and c_custkey % 2 = 0 then null when c_custkey % 5 = 2 then 'now' when c_custkey % 2 = 1 then null else 'then' end as revoked_at from customer where c_custkey % 5 <> 2 or c_custkey % 2 = 1 union all select c_custkey, 'then' from customer where c_custkey % 5 = 2 and c_custkey % 2 = 0")
def _(s, d):
    """A user's keys of the team that still hold are revoked with the membership; others stay as they are."""
    rows = read(s, d, "customer").select(F.lit("t").alias("team_id"), (F.col("c_custkey") % 5).cast("string").alias("user_id"), F.col("c_custkey").alias("key_id"), F.when(F.col("c_custkey") % 2 == 0, "then").alias("revoked_at"))
    people = s.createDataFrame([("t", "1", "admin", "a"), ("t", "2", "member", "b")], "team_id string, user_id string, role string, created_at string")
    return tenancy.remove_member(people, rows, "t", "2", "now")[1].select("key_id", "revoked_at")


@register("st3_refusals", f"select event_id, row_number() over (partition by team_id, period order by moment, event_id) <= {CAP} as admitted from requests", ("requests",))
def _(s, d):
    """Two micro-batches, the second after the first's counts."""
    rows = view(s, d, "requests").withColumnsRenamed({"moment": "ts", "event_id": "id"})
    half = rows.agg(F.sort_array(F.collect_set(F.substring("ts", 1, 10))).alias("days")).select(F.get("days", (F.size("days") / 2).cast("int"))).first()[0]
    none = s.createDataFrame([], "team_id string, period string, used long")
    first, used = admitted_batch(rows.where(F.col("ts") < half), none, CAP)
    second, _used = admitted_batch(rows.where(F.col("ts") >= half), used, CAP)
    return first.unionByName(second).select(F.col("id").alias("event_id"), "admitted")


HISTOGRAM = """array_to_string(list_transform(range(32), lambda k: len(list_filter(regexp_extract_all(hex(encode(TEXT)), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) % 2 * 16 + instr('0123456789ABCDEF', h[2]) - 1 = k))), ',')"""


@register("s18_embedding", f"select doc_id, {HISTOGRAM.replace('TEXT', 'text')} as vec from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.array_join(byte_histogram(F.col("text")).cast("array<int>"), ",").alias("vec"))


# --- validators ---


@register("p2_names", r"select doc_id, length(name) between 1 and 128 and not regexp_matches(name, '\.\.|/|\\') and regexp_matches(name, '^(?:[\p{L}\p{N}]|[\p{L}\p{N}][\p{L}\p{N} .''_-]{0,126}[\p{L}\p{N}])$') as ok from (select doc_id, trim(regexp_replace(substr(text, 1, 20 + doc_id % 40), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as name from documents)")
def _(s, d):
    return read(s, d, "documents").select("doc_id", tx.valid_name(F.expr("substr(text, 1, 20 + doc_id % 40)")).alias("ok"))


@register("p3_contents", r"select doc_id, trim(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) <> '' and length(text) <= 100000 and not contains(text, chr(0)) as ok from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", tx.valid_content(F.col("text")).alias("ok"))


@register("p4_sources", "select id, length(source_file) between 1 and 512 as ok from drawers", ("drawers",))
def _(s, d):
    return view(s, d, "drawers").select("id", tx.valid_source(F.col("source_file")).alias("ok"))


@register("p6_temporal", "select event_id, case when event_id % 4 = 0 then strftime(ts, '%Y-%m-%d') when event_id % 4 = 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when event_id % 4 = 2 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else null end as canonical from events")
def _(s, d):
    forms = F.expr("case event_id % 4 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 2 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") else date_format(ts, 'yyyy-MM') end")
    return read(s, d, "events").select("event_id", tx.temporal(forms).alias("canonical"))


@register("p8_rooms_exist", "select distinct wing, room from drawers where wing || room in (select wing || room from drawers where team_id = 'team-1') and team_id = 'team-0'", ("drawers",))
def _(s, d):
    rows = view(s, d, "drawers").select("team_id", "wing", "room").distinct()
    return rows.where("team_id = 'team-0'").join(rows.where("team_id = 'team-1'"), ["wing", "room"], "left_semi").select("wing", "room")


@register("p9_skills", r"select doc_id, octet_length(encode(lang)) between 1 and 128 and octet_length(encode(text)) <= 1000000 and trim(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) <> '' and octet_length(encode(text)) <= 1024 as ok from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", tx.valid_skill(F.col("lang"), F.col("text"), F.col("text")).alias("ok"))


# --- text ---

TRIM = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@register("t1_fixed_chunks", f"""with t as (select doc_id, {TRIM} as t from documents),
    w as (select doc_id, t, unnest(range(case when length(t) = 0 then 0 when length(t) <= 1600 then 1 else ceil((length(t) - 1600) / 1280.0)::int + 1 end)) as i from t)
    select doc_id, i::int as chunk_index, regexp_replace(substr(t, i * 1280 + 1, 1600), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as chunk from w""")
def _(s, d):
    return tx.fixed_chunks(read(s, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk")


@register("t2_stride_chunks", "select doc_id, i::int as chunk_index, substr(text, i * 1600 + 1, 1600) as chunk from (select doc_id, text, unnest(range(greatest(1, ceil(length(text) / 1600.0)::int))) as i from documents)")
def _(s, d):
    return tx.stride_chunks(read(s, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk")


def paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Documents, every second one with blank lines between its sentences' lines."""
    return read(s, d, "documents").select("doc_id", F.expr("case when doc_id % 2 = 0 then replace(text, '.\n', '.\n\n') else text end").alias("text"))


BOUNDARY = """t as (select doc_id, regexp_replace(TEXT, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as t from documents),
    w as (select doc_id, t, length(t) as n, 0 as s, null::int as e from t where length(t) > 0
      union all select doc_id, t, n, case when e is null then s else case when e < n then e - 320 else n end end, cut from (
        select doc_id, t, n, s, e, f, case when f >= n then n when b > 0 and f - b - 1 > s + 800 then f - b - 1 when l > 0 and f - l > s + 800 then f - l else f end as cut from (
          select *, instr(reverse(substr(t, s + 1, f - s)), chr(10) || chr(10)) as b, instr(reverse(substr(t, s + 1, f - s)), chr(10)) as l from (
            select doc_id, t, n, case when e is null then s when e < n then e - 320 else n end as s, e, least(case when e is null then s when e < n then e - 320 else n end + 1600, n) as f from w where e is null or e < n)))),
    c as (select doc_id, s, e, regexp_replace(substr(t, s + 1, e - s), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as chunk, length(substr(t, 1, s)) - length(replace(substr(t, 1, s), chr(10), '')) + 1 as line_start, length(substr(t, 1, e)) - length(replace(substr(t, 1, e), chr(10), '')) + 1 as line_end from w where e is not null),
    k as (select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, chunk, line_start::int as line_start, line_end::int as line_end from c where length(chunk) >= 50)"""


@register("t3_boundary_chunks", "with recursive " + BOUNDARY.replace("TEXT", "case when doc_id % 2 = 0 then replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) else text end") + " select * from k")
def _(s, d):
    return tx.boundary_chunks(paragraphs(s, d)).select("doc_id", "chunk_index", "chunk", "line_start", "line_end")


@register("t4_tokens", r"select doc_id, len(t) as n, array_to_string(t, ' ') as tokens from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as t from documents)")
def _(s, d):
    t = tx.tokens(F.col("text"))
    return read(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
COMMON = r"select distinct lower(w) as word from (select unnest(regexp_extract_all(text, '[\p{L}]+')) as w from benchmark)"
FREQ = f"""common as ({COMMON}), m as (select doc_id, unnest(regexp_extract_all(substr(text, 1, 5000), '\\p{{Lu}}\\p{{L}}*')) as entity from documents),
    f as (select doc_id, entity, count(*) as n from m where entity not in ({STOP}) and lower(entity) not in (select word from common) group by all)"""


def common_words(s: SparkSession, d: str) -> DataFrame:
    """The words of the benchmark, as a stand-in for a list of everyday words, which callers give."""
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    return read(s, d, "benchmark").select(F.explode(words).alias("w")).select(F.lower("w").alias("word")).distinct()


@register("t6_entity_counts", f"with {FREQ} select doc_id, entity, n from f")
def _(s, d):
    return frequencies(read(s, d, "documents"), "doc_id", "text", common_words(s, d))


@register("t7_drawer_entities", f"with {FREQ} select doc_id, list_sort(list(entity))[1:25] as entities from f where n >= 2 and length(entity) >= 3 group by doc_id")
def _(s, d):
    return named(read(s, d, "documents"), "doc_id", "text", common_words(s, d))


@register("t8_salient_entities", f"with {FREQ}, r as (select *, row_number() over (partition by doc_id order by n desc, entity) as k from f where n >= 2) select doc_id, list(entity order by k) as entities from r where k <= 5 group by doc_id")
def _(s, d):
    return named(read(s, d, "documents"), "doc_id", "text", common_words(s, d), salient=True)


@register("t9_content_dates", "select event_id, strftime(ts, '%Y-%m-%d') as found from events")
def _(s, d):
    forms = F.expr("""case event_id % 5 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, "'on' MMMM d, yyyy") when 2 then date_format(ts, "d MMM yyyy") when 3 then date_format(ts, 'yyyy/M/d')
        else concat('---\ntitle: x 1999-01-01\ndate: ', date_format(ts, 'MMM d yyyy'), '\n---\nbody') end""")
    return read(s, d, "events").select("event_id", tx.content_date(F.lit("notes.md"), forms).alias("found"))


@register("t11_pointer_lines", r"""with w as (select doc_id, substr(text, 1, 5000) as t from documents), q as (select doc_id, regexp_extract_all(t, '"([^"]{15,150})"', 1) as q,
    regexp_extract_all(t, '(?i)\b(?:built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated)\s+[\w\s]{3,40}') as a from w)
    select doc_id, case when len(q) + len(a) > 0 then array_to_string(list_concat(list_transform(a, lambda x: lower(trim(x)) || '||→id' || doc_id), list_transform(q[1:3], lambda x: '"' || x || '"||→id' || doc_id)), chr(10)) else 'w/r/doc-' || doc_id || '||→id' || doc_id end as lines from q""")
def _(s, d):
    one = F.array(F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    source = F.concat(F.lit("src/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    lines = pointer_lines(source, one, F.col("text"), F.lit("w"), F.lit("r"), F.lit(""), F.array().cast("array<string>"))
    return read(s, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("lines"))


@register("t13_packed", """with recursive l as (select doc_id, string_split(text, chr(10)) as l from documents),
    p as (select doc_id, l, 0 as i, 0 as used, 0 as doc from l union all
      select doc_id, l, i + 1, case when used > 0 and used + octet_length(encode(l[i + 1])) + 1 > 400 then octet_length(encode(l[i + 1])) + 1 else used + octet_length(encode(l[i + 1])) + 1 end,
      case when i = 0 then 1 when used > 0 and used + octet_length(encode(l[i + 1])) + 1 > 400 then doc + 1 else doc end from p where i < len(l))
    select doc_id, string_agg(piece, chr(30) order by doc) as documents from (select doc_id, doc, string_agg(l[i], chr(10) order by i) as piece from p where i > 0 group by doc_id, doc) group by doc_id""")
def _(s, d):
    lines = packed(F.split("text", "\n"), 400)
    return read(s, d, "documents").select("doc_id", F.array_join(lines, "\x1e").alias("documents"))


@register("t14_front_matter", "select doc_id, 'lang: ' || lang as block, text as body from documents")
def _(s, d):
    whole = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---"), F.col("text"))
    block, body = tx.front_matter(whole)
    return read(s, d, "documents").select("doc_id", F.substr(block, F.lit(2)).alias("block"), body.alias("body"))


@register("t15_previews", "select doc_id, substr(text, 1, 300) as preview from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@register("t16_labels", "select id, subject || ' → ' || predicate || ' → ' || object as label from facts", ("facts",))
def _(s, d):
    return view(s, d, "facts").select("id", F.concat_ws(" → ", "subject", "predicate", "object").alias("label"))


@register("i1_drawer_ids", "select doc_id, id from drawers", ("drawers",))
def _(s, d):
    rows = view(s, d, "drawers")
    return rows.select("doc_id", ids.drawer_id(*(F.col(c) for c in ("team_id", "wing", "room", "source_file", "chunk_index", "content"))).alias("id"))


@register("i2_graph_ids", r"""select doc_id, 'hallway_' || wing || '_a_b_' || sha256(wing || chr(0) || 'a' || chr(0) || 'b')[1:8] as hallway,
    sha256(least(wing || chr(0) || room, 'x' || chr(0) || 'y') || chr(1) || greatest(wing || chr(0) || room, 'x' || chr(0) || 'y'))[1:16] as tunnel from drawers""", ("drawers",))
def _(s, d):
    w, r, x, y, a, b = F.col("wing"), F.col("room"), F.lit("x"), F.lit("y"), F.lit("a"), F.lit("b")
    return view(s, d, "drawers").select("doc_id", ids.hallway_id(w, a, b).alias("hallway"), ids.tunnel_id(w, r, x, y).alias("tunnel"))


# --- retrieval ---



@register("d1_nearest", f"with {QUERY} select id, score, row_number() over (order by score desc, id)::int as vec_rank from (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}') order by score desc, id limit 20", ("vectors",))
def _(s, d):
    return retrieval.nearest(view(s, d, "vectors"), TEAM, query_vector(s, d), 20)


@register("d2_distances", f"with {QUERY} select id, greatest(0.0, least(2.0, 1 - score::double)) as distance, greatest(0.0, 1 - greatest(0.0, least(2.0, 1 - score::double))) as similarity from (select v.id, {COSINE} as score from vectors v, q)", ("vectors",))
def _(s, d):
    rows = view(s, d, "vectors")
    score = retrieval.cosine(F.col("vec"), F.array(*map(F.lit, query_vector(s, d))))
    return rows.select("id", distance(score).alias("distance"), similarity(distance(score)).alias("similarity"))


def closets(s: SparkSession, d: str) -> DataFrame:
    """A closet for every third drawer, its content as the document."""
    rows = view(s, d, "drawers").where("doc_id % 3 = 0")
    key = (F.col(c) for c in ("team_id", "wing", "room", "source_file", "content"))
    return rows.select("team_id", ids.closet_id(*key).alias("id"), "wing", "room", "source_file", F.col("content").alias("document"), F.array().cast("array<string>").alias("entities"), "filed_at", "doc_id")


def closet_vectors(s: SparkSession, d: str) -> DataFrame:
    vec = view(s, d, "vectors").select("doc_id", "vec")
    return closets(s, d).join(vec, "doc_id").select(F.concat("team_id", F.lit("::closets")).alias("namespace"), "id", "vec")


CLOSETS = "closets as (select team_id, sha256(team_id || chr(0) || wing || chr(0) || room || chr(0) || source_file || chr(0) || content || chr(0)) as id, wing, room, source_file, content as document, filed_at, doc_id from drawers where doc_id % 3 = 0)"


WORDS = "of the and inon eaea that"
BM25 = rf"""words as (select id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]{{2,}}') as w from pool), facts_ as (select count(*) as n, avg(len(w)::double) as mean from words),
    tf as (select id, len(w) as len, term, count(*) as tf from (select id, w, unnest(w) as term from words) where term in ({", ".join(f"'{w}'" for w in WORDS.split())}) group by all),
    df as (select term, count(*) as df from tf group by term),
    bm as (select id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean)))) as b from tf join df using (term), facts_ group by id)"""


@register("d4_bm25", f"with pool as (select doc_id as id, text as content from documents), {BM25} select id, round(coalesce(b, 0.0), 9) as bm25 from pool left join bm using (id)")
def _(s, d):
    out = retrieval.bm25(read(s, d, "documents"), WORDS, "doc_id", "text")
    return out.select("id", F.round("bm25", 9).alias("bm25"))


SEARCH = f"""with {QUERY}, near as (select *, row_number() over (order by score desc, id) as vec_rank from (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}')),
    pool as (select n.*, d.wing, d.room, d.content, greatest(0.0, least(2.0, 1 - score::double)) as distance from near n join drawers d using (id) where vec_rank <= 30), {BM25},
    s as (select id, wing, room, distance, vec_rank, coalesce(b, 0.0) as b from pool left join bm using (id)),
    f as (select *, 0.6 * greatest(0.0, 1 - distance) + 0.4 * case when max(b) over () > 0 then b / max(b) over () else 0.0 end as fused from s)"""


@register("d7_hybrid_search", f"{SEARCH} select row_number() over (order by fused desc, vec_rank)::int as rank, id, wing, room, vec_rank::int as vec_rank, round(distance, 9) as distance, round(b, 9) as bm25, round(fused, 9) as fused from f order by fused desc, vec_rank limit 10", ("drawers", "vectors"))
def _(s, d):
    hits = retrieval.search(view(s, d, "vectors"), view(s, d, "drawers"), TEAM, WORDS, query_vector(s, d), limit=10)
    return hits.select("rank", "id", "wing", "room", "vec_rank", F.round("distance", 9).alias("distance"), F.round("bm25", 9).alias("bm25"), F.round("fused", 9).alias("fused"))


@register("d7_filtered_search", f"""with {CLOSETS}, {QUERY}, near as (select *, row_number() over (order by score desc, id) as vec_rank from (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}')),
    cn as (select *, row_number() over (order by score desc, id) as k from (select c.id, c.source_file, {COSINE} as score from vectors v join closets c on c.doc_id = v.doc_id, q where c.team_id = '{TEAM}') order by score desc, id limit 5),
    boosts as (select source_file, case when greatest(0.0, least(2.0, 1 - arg_min(score, k)::double)) <= 1.5 then [0.40, 0.25, 0.15, 0.08, 0.04][min(k)]::double else 0.0 end as boost from cn group by source_file),
    pool as (select n.*, d.wing, d.room, d.source_file, d.content, greatest(0.0, least(2.0, 1 - score::double)) as distance from near n join drawers d using (id) where vec_rank <= 10000 and room = 'general' and greatest(0.0, least(2.0, 1 - score::double)) <= 1.0), {BM25},
    f as (select id, wing, room, content, distance, coalesce(b, 0.0) as b, coalesce(boost, 0.0) as boost, vec_rank, 0.6 * greatest(0.0, 1 - distance) + 0.4 * case when max(coalesce(b, 0.0)) over () > 0 then coalesce(b, 0.0) / max(coalesce(b, 0.0)) over () else 0.0 end + coalesce(boost, 0.0) as fused from pool left join bm using (id) left join boosts using (source_file))
    select id, wing, room, content, round(fused, 9) as score, round(b, 9) as bm25_score, round(boost, 9) as closet_boost, round(distance, 9) as distance from f order by fused desc, vec_rank limit 20""", ("drawers", "vectors"))
def _(s, d):
    """As callers search: closets' boosts, a room and a distance, and the hits' whole views."""
    query = query_vector(s, d)
    rows = view(s, d, "drawers")
    boosts = retrieval.closet_boosts(closet_vectors(s, d), closets(s, d), TEAM, query)
    hits = retrieval.search(view(s, d, "vectors"), rows, TEAM, WORDS, query, room="general", limit=20, max_distance=1.0, boosts=boosts)
    out = retrieval.hit_views(hits, rows, TEAM)
    return out.select("id", "wing", "room", "content", *(F.round(c, 9).alias(c) for c in ("score", "bm25_score", "closet_boost", "distance")))


@register("d6_boosts", f"with {QUERY}, near as (select id, score, row_number() over (order by score desc, id) as k from (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}') order by score desc, id limit 5) select source_file, [0.40, 0.25, 0.15, 0.08, 0.04][min(k)]::double as boost from near join drawers using (id) group by source_file", ("drawers", "vectors"))
def _(s, d):
    return retrieval.pointer_boosts(view(s, d, "vectors"), view(s, d, "drawers"), TEAM, query_vector(s, d))


@register("d8_near_duplicate", f"with {QUERY}, t as (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}' order by score desc, v.id limit 1) select id, wing, room, round(greatest(0.0, 1 - greatest(0.0, least(2.0, 1 - score::double))), 9) as similarity, greatest(0.0, 1 - greatest(0.0, least(2.0, 1 - score::double))) >= 0.9 as is_duplicate from t left join drawers using (id)", ("drawers", "vectors"))
def _(s, d):
    out = retrieval.near_duplicate(view(s, d, "vectors"), view(s, d, "drawers"), TEAM, query_vector(s, d))
    return out.select("id", "wing", "room", F.round("similarity", 9).alias("similarity"), "is_duplicate")


@register("d8_nearest_for_each", f"select query_id, arg_min(id, (-score, id)) as id, max(score) as score from (select q.vec_id as query_id, v.id, {COSINE} as score from vectors v, (select vec_id, embedding as q from embeddings where vec_id % 100 = 0) q) group by query_id", ("vectors",))
def _(s, d):
    queries = read(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))  # the stated query set
    return retrieval.nearest_for_each(queries, view(s, d, "vectors"))


def cells(s: SparkSession, d: str) -> CellIndex:
    """The index of all vectors, in a new folder."""
    return CellIndex.build(view(s, d, "vectors"), scratch(s, "cells"))


@register("s16_indexed_search", f"with {QUERY} select id, score, row_number() over (order by score desc, id)::int as vec_rank from (select v.id, {COSINE} as score from vectors v, q where namespace = '{TEAM}') order by score desc, id limit 25", ("vectors",))
def _(s, d):
    """The exact search of the index, opened again from its folder."""
    return CellIndex.open(s, cells(s, d).path).nearest(TEAM, query_vector(s, d), 25)


@register("s16_recall", "select count(*) * 10 as wanted, true as enough from embeddings where vec_id % 100 = 0")
def _(s, d):
    """Whether probing 20 of 24 cells finds 95 of 100 of the ten best, over the stated queries; these vectors have hardly any
    clusters, so few cells don't."""
    index = CellIndex.build(view(s, d, "vectors"), scratch(s, "cells"), cells=24)
    queries = read(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    exact, probed = nearest_join(queries, index, 10), nearest_join(queries, index, 10, probes=20)
    found = exact.join(probed.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return found.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.95 * F.count("*")).alias("enough"))


@register("d7_indexed_search", f"{SEARCH} select row_number() over (order by fused desc, vec_rank)::int as rank, id, wing, room, vec_rank::int as vec_rank, round(distance, 9) as distance, round(b, 9) as bm25, round(fused, 9) as fused from f order by fused desc, vec_rank limit 10", ("drawers", "vectors"))
def _(s, d):
    hits = retrieval.search(cells(s, d), view(s, d, "drawers"), TEAM, WORDS, query_vector(s, d), limit=10)
    return hits.select("rank", "id", "wing", "room", "vec_rank", F.round("distance", 9).alias("distance"), F.round("bm25", 9).alias("bm25"), F.round("fused", 9).alias("fused"))


@register("d8_neighbour_join", f"select query_id, id, score, place::int as place from (select q.vec_id::varchar as query_id, v.id, {COSINE} as score, row_number() over (partition by q.vec_id order by {COSINE} desc, v.id) as place from vectors v, (select vec_id, embedding as q from embeddings) q) where place <= 3", ("vectors",))
def _(s, d):
    """The three nearest vectors of all teams for every embedding."""
    return nearest_join(read(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), cells(s, d), 3)


# --- graph ---


def _walk_sql(start: str, hops: int) -> str:
    """The walk level by level, over all pairs of neighbours."""
    parts = [f"n as ({NODES}), bw as (select room, unnest(wings) as wing from n), f0 as (select '{start}' as room, 0 as hop, []::varchar[] as place, []::varchar[] as via)"]
    for h in range(1, hops + 1):
        seen = " union all ".join(f"select room from f{k}" for k in range(h))
        parts.append(f"p{h} as (select b.room, f.room as parent, f.place, list_sort(list(distinct b.wing)) as via from f{h - 1} f join bw a on a.room = f.room join bw b on b.wing = a.wing where b.room not in ({seen}) group by b.room, f.room, f.place)")
        parts.append(f"f{h} as (select room, {h} as hop, list_append(min(place), room) as place, arg_min(via, place) as via from p{h} group by room)")
    every = " union all ".join(f"select * from f{k}" for k in range(hops + 1))
    return f"with {', '.join(parts)} select n.room, array_to_string(wings, ',') as wings, drawers, hop, array_to_string(via, ',') as connected_via from n join ({every}) w on w.room = n.room order by hop, drawers desc, n.room limit 50"


@register("g1_traverse", _walk_sql("r001", 6), ("drawers",))
def _(s, d):
    out = graph.traverse(view(s, d, "drawers"), "r001", 6)
    return out.select("room", F.array_join("wings", ",").alias("wings"), "drawers", "hop", F.array_join("connected_via", ",").alias("connected_via"))


@register("g2_find_tunnels", f"select * from ({NODES}) where len(wings) >= 2 order by drawers desc, room limit 50", ("drawers",))
def _(s, d):
    return graph.find_tunnels(view(s, d, "drawers"))


@register("g3_graph_stats", f"with n as ({NODES}), t as (select room from n where len(wings) >= 2 order by len(wings) desc, drawers desc, room limit 10) select count(*) as rooms, count(*) filter (where len(wings) >= 2) as tunnel_rooms, coalesce(sum(len(wings) * (len(wings) - 1) // 2), 0)::bigint as edges, (select string_agg(room, ',' order by len(wings) desc, drawers desc, room) from n join t using (room)) as top_tunnels from n", ("drawers",))
def _(s, d):
    return graph.graph_stats(view(s, d, "drawers"))


@register("g3_rooms_per_wing", "select wing, count(distinct room) as rooms from drawers where room <> 'general' group by wing", ("drawers",))
def _(s, d):
    return graph.rooms_per_wing(view(s, d, "drawers"))


ENTITY_DRAWERS = f"{FREQ}, e as (select 'w' || doc_id % 2 as wing, 'r' || doc_id % 5 as room, list_sort(list(entity))[1:25] as e from f where n >= 2 and length(entity) >= 3 group by doc_id), u as (select wing, room, e, unnest(range(1, len(e) + 1)) as i from e), p as (select wing, room, e[i] as entity_a, unnest(e[i + 1:]) as entity_b from u), halls as (select wing, entity_a, entity_b, count(*) as together, list_sort(list(distinct room)) as rooms from p group by wing, entity_a, entity_b having count(*) >= 2)"


def entity_drawers(s: SparkSession, d: str) -> DataFrame:
    found = named(read(s, d, "documents"), "doc_id", "text", common_words(s, d))
    return found.select(F.concat(F.lit("w"), (F.col("doc_id") % 2).cast("string")).alias("wing"), F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("room"), "entities")


@register("a8_hallways", f"with {ENTITY_DRAWERS} select wing, entity_a, entity_b, together, rooms from halls")
def _(s, d):
    return graph.hallways(entity_drawers(s, d)).select("wing", "entity_a", "entity_b", "together", "rooms")


@register("g7_entity_tunnels", f"with {ENTITY_DRAWERS}, x as (select distinct wing, unnest([entity_a, entity_b]) as entity from halls) select a.wing as source_wing, b.wing as target_wing, 'entity:' || a.entity as room, 'shared entity: ' || a.entity as label from x a join x b using (entity) where a.wing < b.wing")
def _(s, d):
    return graph.entity_tunnels(graph.hallways(entity_drawers(s, d))).select("source_wing", "target_wing", "room", "label")


@register("g8_recompute", f"with {ENTITY_DRAWERS} select wing, entity_a, entity_b, together, rooms from halls union all select 'w9', 'A', 'B', 2, ['r1']")
def _(s, d):
    """The first wing's drawers are new; the hallways of a wing without drawers stay, as nothing is pruned."""
    rows = kept(entity_drawers(s, d))  # read for the stored hallways, the wings and the fresh ones
    stored = graph.hallways(rows.where("wing = 'w0'"))
    gone = graph.hallways(s.createDataFrame([("w9", "r1", ["A", "B"]), ("w9", "r1", ["B", "A"])], "wing string, room string, entities array<string>"))
    return graph.recompute(rows, stored.unionByName(gone))[0].select("wing", "entity_a", "entity_b", "together", "rooms")


@register("g8_delta_hallways", f"with {ENTITY_DRAWERS} select wing, entity_a, entity_b, together, rooms from halls")
def _(s, d):
    """Hallways kept by deltas: some drawers come with a wrong room, go again, and the rest comes, in three batches of which one is repeated."""
    named_ = named(read(s, d, "documents"), "doc_id", "text", common_words(s, d))
    rows = kept(named_.select("doc_id", F.concat(F.lit("w"), (F.col("doc_id") % 2).cast("string")).alias("wing"), F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("room"), "entities"))  # every batch reads it
    some = rows.where("doc_id % 3 = 1")
    table = graph.pair_table(s, scratch(s, "pairs"), buckets=16)
    graph.apply_drawers(table, "first", rows.where("doc_id % 3 = 0").unionByName(some.withColumn("room", F.lit("rx"))))
    for _again in range(2):
        graph.apply_drawers(table, "moved", some, some.withColumn("room", F.lit("rx")))
    graph.apply_drawers(table, "rest", rows.where("doc_id % 3 = 2"))
    return graph.maintained_hallways(table.read()).select("wing", "entity_a", "entity_b", "together", "rooms")


@register("g8_recompute_pruned", f"with {ENTITY_DRAWERS} select wing, entity_a, entity_b, together from halls")
def _(s, d):
    rows = kept(entity_drawers(s, d))  # read for the wings and their hallways
    gone = graph.hallways(s.createDataFrame([("w9", "r1", ["A", "B"]), ("w9", "r1", ["B", "A"])], "wing string, room string, entities array<string>"))
    return graph.recompute(rows, gone, prune=True)[0].select("wing", "entity_a", "entity_b", "together")


@register("w13_deletes", "select id, source_wing, target_wing, true as existed from (select id, wing as source_wing, wing as target_wing, room from drawers) where room <> 'general' and id <> (select min(id) from drawers where room <> 'general')", ("drawers",))
def _(s, d):
    """Explicit tunnels without one and without all of another kind."""
    own = room_tunnels(s, d).withColumn("kind", F.lit("explicit"))
    both = own.unionByName(own.withColumns({"id": F.concat(F.lit("e"), "id"), "kind": F.lit("entity")}))
    kept, existed = graph.delete_by_id(graph.delete_kind(both, "entity"), own.agg(F.min("id")).first()[0])
    return kept.select("id", "source_wing", "target_wing").crossJoin(existed)  # one row


@register("w13_replace_wing", f"with {ENTITY_DRAWERS} select wing, entity_a, entity_b from halls where wing <> 'w0' union all select 'w0', 'A', 'B'")
def _(s, d):
    fresh = graph.hallways(s.createDataFrame([("w0", "r1", ["A", "B"]), ("w0", "r1", ["B", "A"])], "wing string, room string, entities array<string>"))
    return graph.replace_wing(graph.hallways(entity_drawers(s, d)), "w0", fresh).select("wing", "entity_a", "entity_b")


def room_tunnels(s: SparkSession, d: str) -> DataFrame:
    """Explicit tunnels from each drawer's place to the general room of its wing."""
    rows = view(s, d, "drawers").where("room <> 'general'")
    return rows.select(F.col("wing").alias("source_wing"), F.col("room").alias("source_room"), F.col("id").alias("source_drawer_id"), F.col("wing").alias("target_wing"), F.lit("general").alias("target_room"), F.lit("").alias("target_drawer_id"), F.lit("l").alias("label"), F.col("filed_at").alias("created_at"), "id")


@register("g5_follow", "select 'incoming' as direction, wing, room, 'l' as label, substr(content, 1, 300) as preview from drawers where wing = 'w001' and room <> 'general'", ("drawers",))
def _(s, d):
    return graph.follow_tunnels(room_tunnels(s, d), view(s, d, "drawers"), "w001", "general")


@register("g6_list_tunnels", "select id, filed_at as created_at from drawers where wing = 'w001' and room <> 'general'", ("drawers",))
def _(s, d):
    return graph.list_tunnels(room_tunnels(s, d), "w001").select("id", "created_at")


# --- facts ---

HOLDS = "(valid_from = '' or valid_from || 'T00:00:00Z' <= '2024-01-15T00:00:00Z') and (valid_to = '' or valid_to || 'T23:59:59Z' >= '2024-01-15T00:00:00Z')"


@register("k2_in_effect", f"select id, subject, predicate, object from facts where {HOLDS}", ("facts",))
def _(s, d):
    return view(s, d, "facts").where(kg.in_effect("2024-01-15")).select("id", "subject", "predicate", "object")


@register("k2_in_effect_for", """select q.event_id as question_id, f.id from (select event_id, concat('user_', user_id) as entity, cast(cast(ts as date) as varchar) as day from events) q join facts f on f.subject = q.entity
    where (valid_from = '' or valid_from <= day) and (valid_to = '' or valid_to >= day)""", ("facts",))
def _(s, d):
    """Every event asks what held for its user on its day."""
    asked = read(s, d, "events").select(F.col("event_id").alias("question_id"), F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("entity"), F.date_format("ts", "yyyy-MM-dd").alias("as_of"))
    return kg.in_effect_for(view(s, d, "facts"), asked).select("question_id", "id")


@register("k3_query", f"select 'outgoing' as direction, 'User_1' as subject, predicate, object, valid_from, valid_to, valid_to = '' as current from facts where subject = 'user_1' and {HOLDS}", ("facts",))
def _(s, d):
    return kg.query(view(s, d, "facts"), "User_1", "2024-01-15", "both")


@register("k4_timeline", "select id, subject, predicate, object, valid_from, valid_to from facts where subject = 'user_1' or object = 'user_1' order by valid_from = '', valid_from, id limit 100", ("facts",))
def _(s, d):
    return kg.timeline(view(s, d, "facts"), "user_1").select("id", "subject", "predicate", "object", "valid_from", "valid_to")


@register("k3_normalised", f"select 'incoming' as direction, subject, predicate, 'K_1' as object, valid_from, valid_to, valid_to = '' as current from facts where object = 'k_1'", ("facts",))
def _(s, d):
    """The same over facts with stored ids, which a scan can prune by."""
    return kg.query(kg.normalised(view(s, d, "facts")), "K 1", None, "incoming").withColumn("object", F.lit("K_1"))


@register("w14_add_facts", """select subject, predicate, object, valid_from, valid_to from facts union all select subject, predicate || '_new', object, min(valid_from), '' from facts group by subject, predicate, object
    union all select subject, predicate || '_ended', object, valid_from, min(valid_to) from facts where valid_to <> '' and valid_to >= valid_from group by subject, predicate, object, valid_from
    union all select subject, predicate || '_ended', object, min(valid_from), '' from facts f where valid_to = '' and not exists (select 1 from facts g where g.subject = f.subject and g.predicate = f.predicate and g.object = f.object and g.valid_from = f.valid_from and g.valid_to <> '') group by subject, predicate, object""", ("facts",))
def _(s, d):
    """New triples with one open fact each, the facts of others as they ended, and current ones again, which add nothing."""
    rows = view(s, d, "facts")
    plain = rows.select("subject", "predicate", "object", "valid_from", "valid_to")
    fact = lambda predicate, valid_to: F.struct(predicate.alias("predicate"), valid_to.alias("valid_to"))
    opened, ended = fact(F.concat("predicate", F.lit(" New")), F.lit("")), fact(F.concat(F.lit(" "), "predicate", F.lit(" Ended")), F.col("valid_to"))
    again = F.when(F.col("valid_to") == "", fact(F.col("predicate"), F.col("valid_to")))
    each = plain.select("subject", "object", "valid_from", F.explode(F.array_compact(F.array(opened, ended, again))).alias("f"))  # facts are worked out once for all three
    out = kg.add(rows, each.select("subject", "f.predicate", "object", "valid_from", "f.valid_to"), NOW)
    return out.select("subject", F.lower(F.replace(F.trim("predicate"), F.lit(" "), F.lit("_"))).alias("predicate"), "object", "valid_from", "valid_to")


@register("w15_invalidate", "select id, case when subject = 'user_1' and predicate = 'click' and valid_to = '' and object = (select min(object) from facts where subject = 'user_1' and predicate = 'click' and valid_to = '') then '2030-01-01' else valid_to end as valid_to from facts", ("facts",))
def _(s, d):
    rows = view(s, d, "facts")
    current = rows.where("subject = 'user_1' and predicate = 'click' and valid_to = ''").agg(F.min("object")).first()[0]
    return kg.invalidate(rows, "User_1", "click", current or "", "2030-01-01").select("id", "valid_to")


@register("j5_names", "select id, case when subject = 'user_1' then '' else subject end as subject, predicate, case when object = 'user_1' then '' else object end as object from facts", ("facts",))
def _(s, d):
    rows = view(s, d, "facts")
    names = kg.entities(rows).where("name <> 'user_1'")
    triples = rows.select("id", ids.entity_id(F.col("subject")).alias("subject_id"), "predicate", ids.entity_id(F.col("object")).alias("object_id"))
    return kg.with_names(triples, names).select("id", "subject", "predicate", "object")


# --- writes ---


@register("w1_add", f"""with t as (select doc_id, {TRIM} as t from documents),
    w as (select doc_id, t, unnest(range(case when length(t) = 0 then 0 when length(t) <= 1600 then 1 else ceil((length(t) - 1600) / 1280.0)::int + 1 end)) as i from t),
    c as (select doc_id, i, sha256('t' || chr(0) || 'w' || chr(0) || 'r' || chr(0) || doc_id % 2 || chr(0) || i || chr(0) || regexp_replace(substr(t, i * 1280 + 1, 1600), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') || chr(0)) as id from w)
    select c.doc_id, c.i::int as chunk_index, c.id, case when c.i > 0 then p.id else '' end as parent_id from c join c p on p.doc_id = c.doc_id and p.i = 0""")
def _(s, d):
    """Documents of two sources, all filed at one time: each keeps its own first chunk as the parent."""
    rows = read(s, d, "documents").select("doc_id", F.lit("t").alias("team_id"), F.lit(" w ").alias("wing"), F.lit("r").alias("room"), (F.col("doc_id") % 2).cast("string").alias("source_file"), F.col("text").alias("content"), F.lit(NOW).alias("filed_at"), F.lit("").alias("content_date"))
    return dw.add(rows).select("doc_id", "chunk_index", "id", "parent_id")


@register("w2_update", "select id, case when id = (select min(id) from drawers) then 'new' else room end as room from drawers", ("drawers",))
def _(s, d):
    rows = view(s, d, "drawers")
    return dw.update(rows, rows.agg(F.min("id")).first()[0], room="new", wing=" ").select("id", "room")


@register("w3_delete", "select id from drawers where id <> (select min(id) from drawers)", ("drawers",))
def _(s, d):
    rows = view(s, d, "drawers")
    return dw.delete(rows, view(s, d, "vectors"), rows.agg(F.min("id")).first()[0])[0].select("id")


MINED = BOUNDARY.replace("TEXT", "text").replace("from documents)", "from drawers_ where length(text) <= 100000 and not contains(text, chr(0)))")


@register("w4_mine_drawers", f"""with drawers_ as (select doc_id, content as text from drawers), {MINED}, {FREQ.replace("select doc_id, unnest(regexp_extract_all(substr(text, 1, 5000)", "select doc_id, chunk_index, unnest(regexp_extract_all(substr(chunk, 1, 5000)").replace("from documents)", "from k)").replace("select doc_id, entity, count(*) as n from m", "select doc_id, chunk_index, entity, count(*) as n from m")},
    e as (select doc_id, chunk_index, array_to_string(list_sort(list(entity))[1:25], ',') as entities from f where n >= 2 and length(entity) >= 3 group by all)
    select d.source_file, k.chunk_index, sha256(d.team_id || chr(0) || d.wing || chr(0) || d.room || chr(0) || d.source_file || chr(0) || k.chunk_index || chr(0) || chunk || chr(0)) as id, line_start, line_end, coalesce(entities, '') as entities
    from k join drawers d using (doc_id) left join e on e.doc_id = k.doc_id and e.chunk_index = k.chunk_index""", ("drawers",))
def _(s, d):
    return dw.mine(mined_docs(s, d), common_words(s, d))[0].select("source_file", "chunk_index", "id", "line_start", "line_end", F.array_join("entities", ",").alias("entities"))


@register("w4_mine_closets", rf"""with drawers_ as (select doc_id, content as text from drawers), {MINED}, {FREQ},
    salient as (select doc_id, string_agg(entity, ';' order by n desc, entity) as entities from (select *, row_number() over (partition by doc_id order by n desc, entity) as place from f where n >= 2) where place <= 5 group by doc_id),
    firsts as (select k.doc_id, string_agg(sha256(d.team_id || chr(0) || d.wing || chr(0) || d.room || chr(0) || d.source_file || chr(0) || k.chunk_index || chr(0) || chunk || chr(0)), ',' order by k.chunk_index) filter (where k.chunk_index < 3) as ids,
      arg_min(line_start, k.chunk_index) as line_start, arg_min(line_end, k.chunk_index) as line_end from k join drawers d using (doc_id) group by k.doc_id),
    heads as (select *, regexp_extract_all(substr(content, 1, 5000), '"([^"]{{15,150}})"', 1)[1:3] as q,
      regexp_extract_all(substr(content, 1, 5000), '(?i)\b(?:built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated)\s+[\w\s]{{3,40}}') as a from drawers),
    lines as (select h.doc_id, list_transform(case when len(q) + len(a) > 0 then list_concat(list_transform(a, lambda x: lower(trim(x))), list_transform(q, lambda x: '"' || x || '"')) else [wing || '/' || room || '/doc-' || h.doc_id] end,
      lambda x: x || '|' || coalesce(entities, '') || '|' || substr(filed_at, 1, 10) || ':L' || line_start || '-L' || line_end || '|→' || ids) as l from heads h join firsts on firsts.doc_id = h.doc_id left join salient on salient.doc_id = h.doc_id),
    packs as (select doc_id, l, 0 as i, 0 as used, 0 as doc from lines union all
      select doc_id, l, i + 1, case when used > 0 and used + octet_length(encode(l[i + 1])) + 1 > 1500 then octet_length(encode(l[i + 1])) + 1 else used + octet_length(encode(l[i + 1])) + 1 end,
      case when i = 0 then 1 when used > 0 and used + octet_length(encode(l[i + 1])) + 1 > 1500 then doc + 1 else doc end from packs where i < len(l)),
    docs as (select doc_id, doc, string_agg(l[i], chr(10) order by i) as document from packs where i > 0 group by doc_id, doc)
    select source_file, doc as seq, sha256(team_id || chr(0) || wing || chr(0) || room || chr(0) || source_file || chr(0) || doc || chr(0)) as id, document from docs join drawers using (doc_id)""", ("drawers",))
def _(s, d):
    return dw.mine(mined_docs(s, d), common_words(s, d))[1].select("source_file", "seq", "id", "document")


def mined_docs(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "drawers").select("team_id", "wing", "room", "source_file", "content", "filed_at")


CHANGED = "doc_id % 3 = 0 and doc_id % 7 <> 0"


@register("w4_replace", f"""with drawers_ as (select doc_id, case when {CHANGED} then substr(content, 1, 1000) else content end as text from drawers), {MINED}
    select d.source_file, d.wing, k.chunk_index, sha256(d.team_id || chr(0) || d.wing || chr(0) || d.room || chr(0) || d.source_file || chr(0) || k.chunk_index || chr(0) || chunk || chr(0)) as id from k join drawers d using (doc_id)""", ("drawers",))
def _(s, d):
    """Sources mined again with shorter contents, under names with blanks around them; some of the new contents are too long, so their
    sources stay as they are."""
    docs = view(s, d, "drawers").select("team_id", "wing", "room", "source_file", "content", "filed_at", "doc_id")
    changed = docs.where("doc_id % 3 = 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("x"), 100_001)).otherwise(F.substring("content", 1, 1000)))
    changed = changed.withColumns({c: F.concat(F.lit(" "), c, F.lit("\t")) for c in ("wing", "room", "source_file")}).drop("doc_id")
    rows, pointers = dw.mine(docs.drop("doc_id"))
    return dw.mined_into(rows, pointers, changed)[0].select("source_file", "wing", "chunk_index", "id")


@register("w5_journal_write", f"""select agent, seed, i::int as chunk_index, content, sha256('{TEAM}' || chr(0) || wing || chr(0) || 'diary' || chr(0) || agent || chr(0) || 'general' || chr(0) || i || chr(0) || content || chr(0) || seed || chr(0)) as id from (
    select lower(role) as agent, conv_id || '-' || turn as seed, 'wing_' || conv_id % 5 as wing, i, substr(text, i * 1600 + 1, 1600) as content from (select *, unnest(range(greatest(1, ceil(length(text) / 1600.0)::int))) as i from conversations))""")
def _(s, d):
    rows = view(s, d, "journal").select(F.lit(TEAM).alias("team_id"), F.upper("agent").alias("agent"), F.lit("").alias("topic"), "wing", "content", "filed_at", F.col("id").alias("seed"))
    return dw.write_journal(rows).select("agent", "seed", "chunk_index", "content", "id")


@register("w6_journal_read", "select id, filed_at, (select count(*) from journal where agent = 'user') as total from journal where agent = 'user' order by filed_at desc, id limit 10", ("journal",))
def _(s, d):
    return dw.read_journal(view(s, d, "journal"), " User ").select("id", "filed_at", "total")


@register("w7_absorb", "select id, wing, content, filed_at, id in (select id from vectors) as embedded, (select count(*) from drawers) as taken from drawers", ("drawers", "vectors"))
def _(s, d):
    rows = embedded(s, d)
    out, taken = dw.absorb(rows, rows.drop("embedded_at", "id"), NOW)
    return out.select("id", "wing", "content", "filed_at", F.col("embedded_at").isNotNull().alias("embedded")).crossJoin(taken)  # one row


@register("w7_absorb_into", "select id, wing, content, filed_at, id in (select id from vectors) as embedded from drawers", ("drawers", "vectors"))
def _(s, d):
    """Records absorbed into a stored table that has their drawers: what has a vector keeps its mark."""
    rows = embedded(s, d)
    table = BucketTable.create(s, scratch(s, "drawers"), rows.schema, ["team_id", "id"], buckets=16)
    table.merge("there", rows.where("doc_id % 3 <> 0 or embedded_at is not null"))
    imports.absorb_into(table, "bundle", view(s, d, "drawers").drop("id"), NOW)
    return table.read().select("id", "wing", "content", "filed_at", F.col("embedded_at").isNotNull().alias("embedded"))


@register("w7_absorb_closets", f"with {CLOSETS} select id, wing, room, source_file, document, case when doc_id % 2 = 0 then filed_at else '{NOW}' end as filed_at, (select count(*) from closets) as taken from closets", ("drawers",))
def _(s, d):
    rows = closets(s, d)
    records = rows.drop("id").withColumn("filed_at", F.when(F.col("doc_id") % 2 == 0, F.col("filed_at")).otherwise(" ")).withColumn("wing", F.concat(F.lit(" "), "wing"))
    blank = records.withColumn("document", F.lit(" \n"))
    out, taken = dw.absorb_closets(rows.limit(0), records.unionByName(blank), NOW)
    return out.select("id", "wing", "room", "source_file", "document", "filed_at").crossJoin(taken)  # one row


@register("s8_closets", f"with {CLOSETS} select id, 'wing' as asked from closets where team_id = '{TEAM}' and wing = 'w001' union all select id, 'source' from closets where team_id = '{TEAM}' and source_file = 'src/doc-6.md' union all select c.id, 'ids' from closets c where team_id = '{TEAM}' and c.doc_id in (select doc_id from vectors)", ("drawers", "vectors"))
def _(s, d):
    rows = closets(s, d)
    asked = {"wing": dw.closets_by(rows, TEAM, wing="w001"), "source": dw.closets_by(rows, TEAM, source="src/doc-6.md"), "ids": dw.closets_by(rows, TEAM, wanted=closet_vectors(s, d))}
    parts = [found.select("id", F.lit(name).alias("asked")) for name, found in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])


@register("w8_import", f"""with k as (select *, case doc_id % 6 when 0 then 'closet' when 1 then 'kg' when 2 then 'tunnel' when 3 then 'other' else 'drawer' end as kind from drawers where doc_id % 6 <> 5 or doc_id % 12 = 5),
    places as (select distinct wing, room from k where kind = 'drawer' and doc_id % 12 <> 4),
    n as (select count(*) filter (where kind = 'drawer' and doc_id % 12 <> 4) as drawers, count(*) filter (where kind = 'closet') as closets, count(*) filter (where kind = 'kg' and doc_id % 12 = 1) as facts,
      count(*) filter (where kind = 'tunnel' and (wing, room) in (select (wing, room) from places)) as tunnels, count(*) as records from k)
    select drawers, closets, facts, tunnels, records - drawers - closets - facts - tunnels as skipped, drawers as drawer_rows, closets as closet_rows, facts as fact_rows,
      (select count(distinct (wing, room)) from k where kind = 'tunnel' and (wing, room) in (select (wing, room) from places)) as tunnel_rows from n""", ("drawers",))
def _(s, d):
    """A bundle of all kinds; of drawers some are blank, of facts some have no subject, of tunnels some have no rooms."""
    n = F.col("doc_id")
    kind = F.when(n % 6 == 0, "closet").when(n % 6 == 1, "kg").when(n % 6 == 2, "tunnel").when(n % 6 == 3, "other").otherwise("drawer")
    rows = view(s, d, "drawers").where("doc_id % 6 <> 5 or doc_id % 12 = 5").select(
        kind.alias("kind"), F.when(n % 12 == 4, " ").otherwise(F.col("wing")).alias("wing"), "room", "source_file", "chunk_index", "content", F.col("content").alias("document"), F.array().cast("array<string>").alias("entities"), "filed_at", "content_date",
        F.when(n % 12 == 1, F.col("source_file")).otherwise("").alias("subject"), F.lit("is in").alias("predicate"), F.col("wing").alias("object"), F.lit("2024-01-01").alias("valid_from"), F.lit("").alias("valid_to"),
        *(F.col(c).alias(f"{side}_{c}") for side in ("source", "target") for c in ("wing", "room")), F.lit("l").alias("label"),
    )
    empty = {
        "drawers": "team_id string, id string, wing string, room string, source_file string, chunk_index int, content string, entities array<string>, filed_at string, content_date string, embedded_at string",
        "closets": "team_id string, id string, wing string, room string, source_file string, document string, entities array<string>, filed_at string, embedded_at string",
        "facts": "id string, subject string, predicate string, object string, valid_from string, valid_to string",
        "tunnels": "id string, source_wing string, source_room string, target_wing string, target_room string, label string, created_at string, updated_at string",
    }
    tables, counts = imports.routed(rows, {k: s.createDataFrame([], v) for k, v in empty.items()}, TEAM, NOW)
    for name in empty:
        counts = counts.crossJoin(tables[name].agg(F.count("*").alias(f"{name[:-1]}_rows")))  # one row each
    return counts


@register("w10_copy_wing", f"with c as (select 'team-9' as namespace, sha256('team-9' || chr(0) || d.wing || chr(0) || d.room || chr(0) || d.source_file || chr(0) || d.chunk_index || chr(0) || d.content || chr(0)) as id, {VEC} as first, v.id is not null as found from drawers d left join vectors v using (id) where d.team_id = 'team-0' and d.wing = 'w001') select namespace, id, first, (select count(*) from c where found) as copied, (select count(*) from c where not found) as skipped from c where found", ("drawers", "vectors"))
def _(s, d):
    rows, vec, counts = dw.copy_wing(view(s, d, "drawers"), view(s, d, "vectors"), "team-0", "team-9", "w001")
    return vec.join(rows.select("id"), "id").select("namespace", "id", vec_text(F.col("vec")).alias("first")).crossJoin(counts)  # one row


@register("w10_copy_closets", f"with {CLOSETS}, c as (select 'team-9::closets' as namespace, sha256('team-9' || chr(0) || c.wing || chr(0) || c.room || chr(0) || c.source_file || chr(0) || c.document || chr(0)) as id, {VEC} as first, v.id is not null as found from closets c left join vectors v on v.doc_id = c.doc_id where c.team_id = 'team-0' and c.wing = 'w001') select namespace, id, first, (select count(*) from c where found) as copied, (select count(*) from c where not found) as skipped from c where found", ("drawers", "vectors"))
def _(s, d):
    rows, vec, counts = dw.copy_wing(closets(s, d), closet_vectors(s, d), "team-0", "team-9", "w001", closets=True)
    return vec.join(rows.select("id"), "id").select("namespace", "id", vec_text(F.col("vec")).alias("first")).crossJoin(counts)  # one row


@register("w11_merge_wings", "select id, case when wing in ('w001', 'w002') then 'w000' else wing end as wing from drawers", ("drawers",))
def _(s, d):
    return dw.merge_wings(view(s, d, "drawers"), ["w001", "w002", "w000"], "w000").select("id", "wing")


@register("j12_wing_duplicates", "select a.wing, b.wing as duplicate, a.n as drawers, b.n as duplicate_drawers from (select wing, count(*) as n from w group by wing) a join (select wing, count(*) as n from w group by wing) b on b.wing = 'wing_' || a.wing".replace("from w ", "from (select case when doc_id % 2 = 0 then 'wing_' || wing else wing end as wing from drawers) "), ("drawers",))
def _(s, d):
    wing = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("wing_"), "wing")).otherwise(F.col("wing"))
    return dw.wing_duplicates(view(s, d, "drawers").withColumn("wing", wing))


@register("w12_tunnels", "with p as (select distinct wing, room from drawers where room <> 'general' and wing in (select wing from drawers where room = 'general')) select sha256(least(wing || chr(0) || room, wing || chr(0) || 'general') || chr(1) || greatest(wing || chr(0) || room, wing || chr(0) || 'general'))[1:16] as id, case when wing <= 'w001' then 'general' else room end as source_room, case when wing <= 'w001' then room else 'general' end as target_room, 'l' as label, case when wing <= 'w001' then 'before' else '2024-03-01T00:00:00Z' end as created_at, '2024-03-01T00:00:00Z' as updated_at from p", ("drawers",))
def _(s, d):
    """Tunnels of the first wings are there in the other direction: they get the new label and time only."""
    new = room_tunnels(s, d).select("source_wing", "source_room", "target_wing", "target_room", "label").distinct()
    none = s.createDataFrame([], "id string, source_wing string, source_room string, target_wing string, target_room string, label string, created_at string, updated_at string")
    turned = new.where("source_wing <= 'w001'").select("source_wing", F.col("target_room").alias("source_room"), "target_wing", F.col("source_room").alias("target_room"), F.lit("old").alias("label"))
    rows = view(s, d, "drawers")
    before = dw.upsert_tunnels(none, turned, rows, "before")
    return dw.upsert_tunnels(before, new, rows, NOW).select("id", "source_room", "target_room", "label", "created_at", "updated_at")


@register("w16_skills", "select 'nation-' || c_nationkey as team_id, c_mktsegment as name, count(*) as version, arg_max(c_name, c_custkey) as content from customer where c_custkey % 3 <> 0 group by all")
def _(s, d):
    rows = read(s, d, "customer").select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("team_id"), F.col("c_mktsegment").alias("name"), F.lit("").alias("description"), F.col("c_name").alias("content"), F.lit("u").alias("updated_by"), F.when(F.col("c_custkey") % 3 == 0, "reader").otherwise("writer").alias("role"), F.col("c_custkey").alias("at"), F.lit(0).alias("id"))
    return tenancy.skill_history(rows).select("team_id", "name", "version", "content")


@register("w18_admitted", f"select event_id, row_number() over (partition by team_id, period order by moment, event_id) <= {CAP} as admitted from requests", ("requests",))
def _(s, d):
    return tenancy.admit(view(s, d, "requests"), CAP, ["moment", "event_id"]).select("event_id", "admitted")


@register("w19_shares", """with recursive e as (select 't' || user_id % 7 as from_team, 't' || user_id % 5 as to_team, event_type as wing, ['request', 'accept', 'request', 'decline', 'reopen'][event_id % 5 + 1] as op,
      row_number() over (partition by user_id % 7, user_id % 5, event_type order by ts, event_id) as k from events where user_id % 7 <> user_id % 5),
    r as (select distinct from_team, to_team, wing, 0::bigint as k, 'none' as status, 0 as requests, 0 as accepted, 0 as declined from e union all
      select r.from_team, r.to_team, r.wing, e.k, case when op = 'request' or (op = 'reopen' and status = 'accepted') then 'pending' when op = 'accept' and status = 'pending' then 'accepted' when op = 'decline' and status = 'pending' then 'declined' else status end,
        requests + (op = 'request' and status <> 'pending')::int, accepted + (op = 'accept' and status = 'pending')::int - (op = 'reopen' and status = 'accepted')::int, declined + (op = 'decline' and status = 'pending')::int
      from r join e on e.from_team = r.from_team and e.to_team = r.to_team and e.wing = r.wing and e.k = r.k + 1)
    select from_team, to_team, wing, arg_max(status, k) as status, max(requests) as requests, arg_max(accepted, k) as accepted, max(declined) as declined from r group by from_team, to_team, wing having max(requests) > 0""")
def _(s, d):
    ops = F.element_at(F.array(*map(F.lit, ("request", "accept", "request", "decline", "reopen"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = read(s, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("from_team"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("to_team"), F.col("event_type").alias("wing"), F.col("ts").cast("string").alias("at"), F.col("event_id").alias("id"), ops.alias("op"))
    return tenancy.shares(rows)


@register("w20_jobs", """with recursive e as (select user_id as job_id, ['enqueue', 'claim', 'release', 'done', 'fail'][event_id % 5 + 1] as op, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events),
    r as (select distinct job_id, 0::bigint as k, 'none' as status, 0::bigint as drawers from e union all
      select r.job_id, e.k, case when op = 'enqueue' and status = 'none' then 'queued' when op = 'claim' and status = 'queued' then 'running' when op = 'done' and status = 'running' then 'done' when op = 'fail' and status = 'running' then 'failed' when op = 'release' and status = 'running' then 'queued' else status end,
        case when op = 'done' and status = 'running' then event_id else drawers end from r join e on e.job_id = r.job_id and e.k = r.k + 1)
    select job_id, arg_max(status, k) as status, arg_max(drawers, k) as drawers from r group by job_id""")
def _(s, d):
    ops = F.element_at(F.array(*map(F.lit, ("enqueue", "claim", "release", "done", "fail"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = read(s, d, "events").select((F.col("user_id")).alias("job_id"), F.col("ts").cast("string").alias("at"), F.col("event_id").alias("id"), ops.alias("op"), F.col("event_id").alias("drawers"))
    return tenancy.job_states(rows)


@register("w22_subscriptions", "select team_id, case when op = 'activate' then 'pro' else 'free' end as plan, case when op = 'activate' then 'active' else 'canceled' end as status from (select user_id as team_id, arg_max(case when event_id % 3 = 0 then 'cancel' else 'activate' end, event_id) as op from events group by user_id)")
def _(s, d):
    rows = read(s, d, "events").select(F.col("user_id").alias("team_id"), F.when(F.col("event_id") % 3 == 0, "cancel").otherwise("activate").alias("op"), F.lit("pro").alias("plan"), F.col("event_id").alias("seq"), F.lit(0).alias("id"), F.col("ts").alias("at"))
    return tenancy.subscriptions(rows).select("team_id", "plan", "status")


@register("j1_members", "select c_custkey as user_id, c_name as email, case when c_custkey % 4 = 0 then 'admin' else 'member' end as role from customer where c_nationkey = 3")
def _(s, d):
    rows = read(s, d, "customer")
    memberships = rows.select(F.col("c_nationkey").cast("string").alias("team_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, "admin").otherwise("").alias("role"), F.col("c_custkey").alias("created_at"))
    return tenancy.members(memberships, rows.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email")), "3").select("user_id", "email", "role")


@register("j15_team_caps", "select c_custkey as team_id, case when c_mktsegment = 'BUILDING' then 10000 else 0 end as cap from customer")
def _(s, d):
    plans = s.createDataFrame([("BUILDING", 10_000)], "plan_id string, monthly_cap int")
    return tenancy.team_caps(read(s, d, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_mktsegment").alias("plan_id")), plans)


# --- streams, as tables ---


@register("st1_metered", "select user_id as team_id, strftime(ts, '%Y-%m') as period, count(*) as used from events group by all")
def _(s, d):
    return metered(read(s, d, "events").select(F.col("user_id").alias("team_id"), "ts"))


@register("st2_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def _(s, d):
    return windowed(read(s, d, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"))




@register("st4_refusal_stream", f"select event_id, row_number() over (partition by team_id, period order by moment, event_id) <= {CAP} as admitted from requests", ("requests",))
def _(s, d):
    """A stateful stream over the requests in two parts by time, ended and started again between them."""
    rows = view(s, d, "requests").select("team_id", F.col("event_id").alias("id"), F.to_timestamp("moment").alias("ts"))
    days = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half = days.a + (days.b - days.a) / 2
    folder = scratch(s, "requests")
    for part in (F.col("ts") < half, F.col("ts") >= half):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        run_refusals(s.readStream.schema(rows.schema).parquet(f"{folder}/in"), CAP, f"{folder}/out", f"{folder}/checkpoint")
    return s.read.parquet(f"{folder}/out").select(F.col("id").alias("event_id"), "admitted")


# --- wire views, filters and the rest of the writes ---


@register("p1_drawer_views", "select id, wing, room, source_file, chunk_index, content, nullif(list_filter([wing, ''], lambda x: x <> '' and doc_id % 2 = 0), []) as entities, case when doc_id % 4 = 0 then 'p' end as parent_id, filed_at, nullif(content_date, '') as content_date from drawers", ("drawers",))
def _(s, d):
    rows = view(s, d, "drawers").withColumns({"entities": F.when(F.col("doc_id") % 2 == 0, F.array("wing")).otherwise(F.array().cast("array<string>")), "parent_id": F.when(F.col("doc_id") % 4 == 0, "p").otherwise("")})
    return retrieval.drawer_views(rows)


@register("p1_tunnel_views", "select id, wing as source_wing, room as source_room, id as source_drawer_id, wing as target_wing, 'general' as target_room, null::varchar as target_drawer_id, 'l' as label, 'explicit' as kind, filed_at as created_at from drawers where room <> 'general'", ("drawers",))
def _(s, d):
    out = graph.tunnel_views(room_tunnels(s, d).withColumn("kind", F.lit("explicit")))
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("source", "target") for c in ("wing", "room", "drawer_id")]
    return out.select("id", *flat, "label", "kind", "created_at")


@register("p1_hallway_views", f"with {ENTITY_DRAWERS} select wing, entity_a, entity_b, together as co_occurrence_count, entity_a || ' ↔ ' || entity_b || ' (co-occur in ' || together || ' drawers across ' || len(rooms) || ' rooms: ' || array_to_string(rooms, ', ') || ')' as label from halls")
def _(s, d):
    return graph.list_hallways(graph.hallways(entity_drawers(s, d))).select("wing", "entity_a", "entity_b", F.col("together").alias("co_occurrence_count"), "label")


@register("p5_fact_values", r"select doc_id, v, length(t) between 1 and 128 and not contains(t, chr(0)) as ok from (select doc_id, v, regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as t from (select doc_id, case doc_id % 5 when 0 then text when 1 then source when 2 then ' ' || lang || ' ' when 3 then ' ' else repeat(lang, 64) end as v from documents))")
def _(s, d):
    """Whole texts, names, blanks and names at the bound."""
    v = F.expr("case doc_id % 5 when 0 then text when 1 then source when 2 then concat(' ', lang, ' ') when 3 then ' ' else repeat(lang, 64) end")
    return read(s, d, "documents").select("doc_id", v.alias("v"), tx.valid_fact_value(v).alias("ok"))


@register("p7_filtered_hits", f"with {QUERY}, n as (select v.id, {COSINE} as score, row_number() over (order by {COSINE} desc, v.id) as k from vectors v, q where namespace = '{TEAM}') select id, room from n join drawers using (id) where k <= 10000 and room = 'general' and greatest(0.0, least(2.0, 1 - score::double)) <= 1.0", ("drawers", "vectors"))
def _(s, d):
    return retrieval.filtered_hits(view(s, d, "vectors"), view(s, d, "drawers"), TEAM, query_vector(s, d), room="general", max_distance=1.0).select("id", "room")


@register("t12_locators", "select doc_id, case when doc_id % 3 = 0 then '2024-01-01' else '2023-05-05' end || ':L1-L' || (length(text) - length(replace(text, chr(10), '')) + 1) as place from documents")
def _(s, d):
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    known = F.when(F.col("doc_id") % 3 == 0, "").otherwise("2023-05-05")
    return read(s, d, "documents").select("doc_id", locator(known, F.lit("2024-01-01"), F.lit(1), lines).alias("place"))


@register("j8_room_neighbours", "select distinct a.room, b.room as other from drawers a join drawers b using (wing) where a.room <> b.room and a.room <> 'general' and b.room <> 'general'", ("drawers",))
def _(s, d):
    places = graph.room_wings(view(s, d, "drawers")).select("room", "wing")
    return places.join(places.withColumnRenamed("room", "other"), "wing").where("room <> other").select("room", "other").distinct()


@register("j16_my_teams", "select distinct c_nationkey as team_id from customer where c_custkey % 10 = 1")
def _(s, d):
    rows = read(s, d, "customer")
    teams = rows.select(F.col("c_nationkey").alias("team_id")).distinct().withColumn("created_at", F.lit(NOW))
    memberships = rows.where("c_custkey % 10 = 1").select(F.col("c_nationkey").alias("team_id"), F.lit("me").alias("user_id"))
    return tenancy.my_teams(memberships, teams, "me").select("team_id")


@register("w9_embed_pending", f"select id, {HISTOGRAM.replace('TEXT', 'content')} as vec from drawers where team_id = '{TEAM}' and id not in (select id from vectors) order by filed_at, id limit 64", ("drawers", "vectors"))
def _(s, d):
    made, _stamped = dw.embed_pending(embedded(s, d), byte_histogram(F.col("content")), NOW, TEAM)
    return made.select("id", F.array_join(F.col("vec").cast("array<int>"), ",").alias("vec"))


@register("w17_skillset", "select arg_max(c_name, c_custkey) as content, count(*) as version from customer where c_mktsegment = 'BUILDING'")
def _(s, d):
    rows = read(s, d, "customer").select((F.col("c_mktsegment") == "BUILDING").alias("is_super"), F.col("c_name").alias("content"), F.col("c_custkey").alias("at"), F.lit(0).alias("id"))
    return tenancy.skillset(rows)


@register("w21_members", "select c_custkey as user_id, case when c_custkey = 1 then 'admin' when c_custkey % 4 = 0 then 'admin' else 'member' end as role from customer where c_custkey <> 2")
def _(s, d):
    rows = read(s, d, "customer").select(F.lit("t").alias("team_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, "admin").otherwise("member").alias("role"))
    return tenancy.set_role(tenancy.set_role(rows, "t", 1, "admin"), "t", 2, None).select("user_id", "role")
