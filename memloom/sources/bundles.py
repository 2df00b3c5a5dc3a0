"""Bundles of records as lines of JSON, one table of a kind-tagged union; and tenants' archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.sources.buckets import BucketTable

RECORD = (
    "kind string, wing string, room string, source_file string, chunk_index int, content string, document string, entities array<string>, filed_at string, content_date string, agent string, topic string, "
    "subject string, predicate string, object string, valid_from string, valid_to string, source_wing string, source_room string, target_wing string, target_room string, label string, total long"
)
KINDS = ("manifest", "drawer", "diary", "closet", "kg", "tunnel")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """All lines; those that aren't JSON, or of no known kind, have the kind `skipped`."""
    rows = spark.read.schema(RECORD + ", _corrupt_record string").option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("kind", F.when(F.col("_corrupt_record").isNull() & F.col("kind").isin(*KINDS), F.col("kind")).otherwise("skipped")).drop("_corrupt_record")


#: Fixed value: the bytes of a bundle that are read at most.
MOST_BYTES = 256 << 20


def ordered_bundle(spark: SparkSession, path: str, most_bytes: int | None = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a bundle that is read in order, file by file and line by line, up to the first line that isn't a JSON object or the
    line in which most_bytes (None: no bound) are passed: what lies before that is kept, what follows isn't, however the files are split.

    rows are those of `read_bundle` before that place; the report is one row (records, bytes, bad_file, bad_line, reason), the last three null
    where all was read, bad_line being the line as it stands. Blank lines are no records.

    A line's place is its file, the start of its split and a number that grows within the split, so lines are never sorted: the first
    bad place is a minimum, and bytes are summed for each split before they are for the lines of the one split that passes the bound."""
    place = F.struct("file", "block", "at")
    read = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = read.withColumns({"at": F.monotonically_increasing_id(), "size": F.octet_length("value") + 1})
    parsed = lines.withColumn("r", F.from_json("value", RECORD + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    blank = F.trim("value") == ""
    wrong = ~blank & (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.ltrim("value").startswith("{"))
    # the split in which the bound is passed, from one row for each split
    bound = F.lit(most_bytes)
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("own")).withColumn("before", F.sum("own").over(Window.orderBy("file", "block")) - F.col("own"))
    crossed = blocks.where((F.col("before") <= bound) & (F.col("before") + F.col("own") > bound)).orderBy("file", "block").limit(1)
    inside = lines.join(F.broadcast(crossed), ["file", "block"]).withColumn("till", F.col("before") + F.sum("size").over(Window.partitionBy("file", "block").orderBy("at")))  # one split
    over = inside.where(F.col("till") > bound).agg(F.min(F.struct("file", "block", "at", "value")).alias("p")).where("p is not null").select("p", F.lit("too many bytes").alias("reason"))
    bad = parsed.where(wrong).agg(F.min(F.struct("file", "block", "at", "value")).alias("p")).where("p is not null").select("p", F.lit("not a record").alias("reason"))
    first = (bad if most_bytes is None else over.unionByName(bad)).orderBy("p").limit(1).collect()  # one row at most
    good = parsed.where(~blank)
    if first:
        p = first[0].p
        good = good.where(place < F.struct(F.lit(p.file).alias("file"), F.lit(p.block).alias("block"), F.lit(p.at).alias("at")))
    rows = good.select("r.*", "size").withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("skipped")).drop("_corrupt_record")
    at = (first[0].p.file, first[0].p.value, first[0].reason) if first else (None, None, None)
    names = ("bad_file", "bad_line", "reason")
    report = rows.agg(F.count("*").alias("records"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")).select("*", *(F.lit(v).cast("string").alias(n) for n, v in zip(names, at, strict=True)))
    return rows.drop("size"), report


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind)


#: The fields of each kind of record, in the order of a bundle.
FIELDS = {
    "drawer": ("wing", "room", "source_file", "chunk_index", "content", "entities", "filed_at", "content_date"), "diary": ("wing", "room", "source_file", "chunk_index", "content", "entities", "filed_at", "content_date", "agent", "topic"),
    "closet": ("wing", "room", "source_file", "document", "entities", "filed_at"), "kg": ("subject", "predicate", "object", "valid_from", "valid_to", "source_file"), "tunnel": ("source_wing", "source_room", "target_wing", "target_room", "label"),
}


def bundle_rows(kind: str, rows: DataFrame) -> DataFrame:
    """The fields that a bundle has of a table, without the team and derived columns."""
    return rows.select(*(c for c in FIELDS[kind] if c in rows.columns))


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("records"))


def write_bundle(spark: SparkSession, path: str, **tables: DataFrame) -> int:
    """Writes a manifest line and the tables (kind to rows) as lines of JSON; returns the records. Fields of a record that
    are null are left out."""
    parts = {kind: bundle_rows(kind, tables[kind]) for kind in FIELDS if kind in tables}
    total = sum(t.count() for t in parts.values())
    # a folder for each kind, numbered in the order that an import needs: rooms before the tunnels between them
    spark.range(1).select(F.to_json(F.struct(F.lit("manifest").alias("kind"), F.lit(total).alias("total"))).alias("value")).write.mode("overwrite").text(f"{path}/part=0-manifest")
    for k, (kind, rows) in enumerate(parts.items(), 1):
        rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/part={k}-{kind}")
    return total


def named_facts(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(subject, predicate, object, valid_from, valid_to) with names for ids, blank ones dropped, and bounds cut to days."""
    a = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject"))
    b = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object"))
    day = [F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1).alias(c) for c in ("valid_from", "valid_to")]
    out = triples.join(a, "subject_id").join(b, "object_id")
    return out.where("trim(subject) <> '' and trim(predicate) <> '' and trim(object) <> ''").select("subject", "predicate", "object", *day)


# --- archives ---

#: How each kind of table is cut to a tenant.
SCOPES = {
    "team": "team_id = {team}", "team_row": "id = {team}", "user": "user_id = {user}", "user_row": "id = {user}", "team_user": "team_id = {team} and user_id = {user}", "share": "from_team = {team} or to_team = {team}",
    "namespace": "namespace = {team} or startswith(namespace, concat({team}, '::'))", "all": "true",
}
#: Columns that an archive blanks.
REDACTED = ("password_hash", "token_enc", "totp_secret")


def archive(tables: dict[str, tuple[DataFrame, str]], team: str, user: str) -> dict[str, DataFrame]:
    """The rows of one tenant from tables (name to rows and scope), secrets blanked and token hashes replaced by row ids. An
    unknown scope matches nothing."""
    out = {}
    for name, (rows, scope) in tables.items():
        condition = SCOPES.get(scope)
        own = rows.where(F.expr(condition.format(team=_text(team), user=_text(user)))) if condition else rows.limit(0)
        for column in own.columns:
            own = own.withColumn(column, F.lit("")) if column in REDACTED else own.withColumn(column, F.col("id").cast("string")) if column == "token_hash" else own
        out[name] = own
    return out


#: The tables of a tenant's archive and how each is cut; others stay out.
MANIFEST = {
    "plans": "all", "users": "user_row", "teams": "team_row", "memberships": "team_user", "api_keys": "team_user", "skills": "team", "usage_counters": "team", "subscriptions": "team", "vectors": "namespace",
    "drawers": "team", "closets": "team", "hallways": "team", "tunnels": "team", "kg_entities": "team", "kg_triples": "team", "share_requests": "share", "merge_jobs": "team",
}


def tenant_archive(tables: dict[str, DataFrame], team: str, user: str) -> dict[str, DataFrame]:
    """The archive of those of tables that the manifest lists, in its order."""
    return archive({name: (tables[name], scope) for name, scope in MANIFEST.items() if name in tables}, team, user)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(rows: DataFrame) -> tuple[Column, Column]:
    """How many rows there are, and a number that all of them make, in any order."""
    return F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")


def versions_of(tables: dict[str, tuple[BucketTable, str]]) -> dict[str, int]:
    """The last version of each of some stored tables: what an archive is read at, whatever is written while it is made."""
    return {name: table.versions()[-1] if table.versions() else 0 for name, (table, _) in tables.items()}


def write_archive(tables: dict[str, tuple[BucketTable, str]], team: str, user: str, folder: str, at: dict[str, int] | None = None) -> DataFrame:
    """Writes a tenant's archive of stored tables (name to table and scope), all as of the versions in `at`, by default the last ones now, and
    beside it a manifest of one row for each table (name, version, rows, digest), which comes last: an archive without one is not whole."""
    at = at or versions_of(tables)
    frames = {name: (table.read(at[name]), scope) for name, (table, scope) in tables.items()}
    for name, rows in archive(frames, team, user).items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values()))[0].spark
    parts = []
    for name in tables:  # the tables of an archive are a fixed few
        rows = spark.read.parquet(f"{folder}/{name}")
        parts.append(rows.agg(*_digest(rows)).select(F.lit(name).alias("name"), F.lit(at[name]).alias("version"), "rows", "digest"))
    manifest = reduce(DataFrame.unionByName, parts)
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema("name string, version int, rows long, digest string").json(f"{folder}/manifest")


def read_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an archive; one whose rows aren't those of its manifest is an error."""
    out = {}
    for line in spark.read.schema("name string, version int, rows long, digest string").json(f"{folder}/manifest").collect():  # a fixed few
        rows = spark.read.parquet(f"{folder}/{line.name}")
        found = rows.agg(*_digest(rows)).first()
        if (found.rows, found.digest) != (line.rows, line.digest):
            raise ValueError(f"{line.name} isn't what its manifest says")
        out[line.name] = rows
    return out
