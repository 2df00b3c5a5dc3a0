"""Writes as transforms from tables to tables: add, update, delete, mine, absorb, copy, merge, and the journal.

Tables are plain DataFrames; a caller writes the result as the next version. Everything is idempotent, ids being digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import ids
from memloom.functions.entities import entities_within, salient_within, with_mentions
from memloom.functions.pointers import MOST_IDS, locator, packed, pointer_lines
from memloom.functions.text import boundary_pieces, content_date, fixed_pieces, stride_chunks, trimmed, valid_content, valid_name, valid_source


def last_of_each(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the greatest by the columns of order, then by all others, so the choice never depends on the run."""
    names = [*order, *(c for c in rows.columns if c not in (*keys, *order))]
    return rows.groupBy(*keys).agg(F.max(F.struct(*names)).alias("__last")).select(*keys, "__last.*").select(*rows.columns)


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in by keys; columns in keep stay as old has them. Of rows of new that repeat a key the last one
    by order counts."""
    names = [c for c in old.columns if c not in keys]
    given = last_of_each(new.select(*(c for c in old.columns if c in new.columns)), keys, order)
    a, b = old.select(*keys, F.struct(*names).alias("__old")), given.select(*keys, F.struct(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in names)).alias("__new"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]  # a null key is a key like any other
    joined = a.alias("a").join(b.alias("b"), same, "full_outer").select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), "__old", "__new")

    def value(c: str) -> Column:
        if c in keep:
            return F.when(F.col("__old").isNotNull(), F.col("__old")[c]).otherwise(F.col("__new")[c])
        return F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c])

    return joined.select(*keys, *(value(c).alias(c) for c in names)).select(*old.columns)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def page(drawers: DataFrame, wing: str | None = None, room: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest drawers first, ties by id."""
    kept = drawers
    for column, v in (("wing", wing), ("room", room)):
        kept = kept.where(F.col(column) == v) if v else kept
    return kept.orderBy(F.desc("filed_at"), "id").offset(offset).limit(limit)


def by_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def add(rows: DataFrame) -> DataFrame:
    """Drawers of rows (team_id, wing, room, source_file, content, filed_at, content_date): chunks with digests as ids; the
    first chunk is the parent of the others. Blank wings, rooms and contents are left out."""
    kept = rows.where((trimmed(F.col("wing")) != "") & (trimmed(F.col("room")) != "") & (trimmed(F.col("content")) != ""))
    place = [F.col(c) for c in ("team_id", "wing", "room", "source_file")]
    cut = kept.withColumns({"wing": trimmed(F.col("wing")), "room": trimmed(F.col("room")), "__pieces": fixed_pieces(F.col("content"))})
    # an id is a digest of the row's own values, so the first chunk's is known before the chunks part
    cut = cut.withColumn("__first", ids.drawer_id(*place, F.lit(0), F.get("__pieces", F.lit(0))))
    rest = [c for c in kept.columns if c not in ("content", "chunk_index", "id", "parent_id")]
    out = cut.select(*rest, "__first", F.posexplode("__pieces").alias("chunk_index", "content"))
    return out.select(*rest, "chunk_index", "content", ids.drawer_id(*place, F.col("chunk_index"), F.col("content")).alias("id"), F.when(F.col("chunk_index") > 0, F.col("__first")).otherwise("").alias("parent_id"))


def replace_sources(drawers: DataFrame, new: DataFrame) -> DataFrame:
    """drawers with the named sources of new replaced whole, within their team, wing and room."""
    sources = new.where("source_file <> ''").select("team_id", "wing", "room", "source_file")
    return keep_latest(without(drawers, sources, ["team_id", "wing", "room", "source_file"]), new, ["team_id", "id"])


def update(drawers: DataFrame, id_: str, **fields: str) -> DataFrame:
    """drawers with the non-blank fields of one row changed and its vector marked as due; its id and entities stay."""
    hit, given = F.col("id") == id_, {k: v for k, v in fields.items() if v and v.strip()}
    changes = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in given.items()}
    if given and "embedded_at" in drawers.columns:
        changes["embedded_at"] = F.when(~hit, F.col("embedded_at"))
    return drawers.withColumns(changes) if changes else drawers


def delete(drawers: DataFrame, vectors: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    return drawers.where(F.col("id") != id_), vectors.where(F.col("id") != id_)


#: The room of a mined source that names none.
MINE_ROOM = "general"


def minable(docs: DataFrame, agent: str = "miner") -> DataFrame:
    """The rows of docs (team_id, wing, room, source_file, content, filed_at) whose names, sources and contents are in bounds: names
    and sources trimmed, a blank room the usual one, and, where docs has agents, in lower case, blank ones named."""
    named = docs.withColumns({"wing": trimmed(F.col("wing")), "room": F.coalesce(F.nullif(trimmed(F.col("room")), F.lit("")), F.lit(MINE_ROOM)), "source_file": trimmed(F.col("source_file"))})
    good = valid_name(F.col("wing")) & valid_name(F.col("room")) & valid_source(F.col("source_file")) & valid_content(F.col("content"))
    if "agent" in docs.columns:
        named = named.withColumn("agent", F.lower(F.coalesce(F.nullif(trimmed(F.col("agent")), F.lit("")), F.lit(agent))))
        good = good & valid_name(F.col("agent"))
    return named.where(good)


def mine(docs: DataFrame, common: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawers, closets) of the `minable` rows of docs: chunks at paragraph and line ends with their entities, the first chunk the
    parent of the others, and packed pointer lines for each source.

    Chunks, entities, dates and pointer lines are worked out within the row of their source, so nothing is shuffled."""
    key = ("team_id", "wing", "room", "source_file")
    place = [F.col(c) for c in key]
    good = minable(docs)
    # conditions on the pieces, the optimizer's own too, aren't pushed below explode, so a content is cut once
    cut = good.withColumn("content_date", content_date(F.col("source_file"), F.col("content"))).select("*", F.explode(F.array(boundary_pieces(F.col("content")))).alias("__pieces"))
    own = lambda k: ids.drawer_id(*place, F.lit(k), F.get("__pieces", F.lit(k))["chunk"])
    rest = [c for c in good.columns if c not in ("content", "chunk_index", "id", "parent_id", "entities", "content_date")]
    each = cut.select(*rest, "content_date", own(0).alias("__first"), F.posexplode("__pieces").alias("chunk_index", "__c"))
    each = each.select(*rest, "content_date", "__first", "chunk_index", "__c.line_start", "__c.line_end", F.col("__c.chunk").alias("content"))
    each = with_mentions(each, "content", "__m", common).withColumn("entities", entities_within(F.col("__m")))
    drawers = each.withColumn("id", ids.drawer_id(*place, F.col("chunk_index"), F.col("content"))).withColumn("parent_id", F.when(F.col("chunk_index") > 0, F.col("__first")).otherwise("")).drop("__first", "__m")
    sources = with_mentions(cut.where(F.size("__pieces") > 0), "content", "__m", common).withColumn("entities", salient_within(F.col("__m")))
    firsts = F.array_compact(F.array(*(F.when(F.size("__pieces") > k, own(k)) for k in range(MOST_IDS))))
    at = locator(F.col("content_date"), F.substring("filed_at", 1, 10), F.get("__pieces", F.lit(0))["line_start"], F.get("__pieces", F.lit(0))["line_end"])
    lines = pointer_lines(F.col("source_file"), firsts, F.col("content"), F.col("wing"), F.col("room"), at, F.col("entities"))
    documents = sources.select(*key, "filed_at", "entities", F.posexplode(packed(lines)).alias("seq", "document"))
    closets = documents.withColumn("seq", F.col("seq") + 1).withColumn("id", ids.closet_id(*place, F.col("seq")))
    return drawers, closets


def mined_into(drawers: DataFrame, closets: DataFrame, docs: DataFrame, common: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables after mining docs. Rows that are refused change nothing; of a mined source the drawers go within its wing and room,
    its closets in all wings, also where its content is too short for a chunk. Of several rows of one source in a wing and room the
    last filed counts, and for its closets the last of all."""
    key = ["team_id", "wing", "room", "source_file"]
    taken = last_of_each(minable(docs), key, ("filed_at", "content"))
    new_drawers, new_closets = mine(taken, common)
    left = without(drawers, taken, key)
    last = taken.groupBy("team_id", "source_file").agg(F.max(F.struct("filed_at", "content", "wing", "room")).alias("l")).select("team_id", "source_file", "l.wing", "l.room")
    left_closets = without(closets, taken, ["team_id", "source_file"])
    return left.unionByName(new_drawers, allowMissingColumns=True), left_closets.unionByName(new_closets.join(last, key, "left_semi"), allowMissingColumns=True)


#: What a drawer's and a closet's id is made of, but for a mined closet's, which has its number in place of the document.
DRAWER_KEY = ("team_id", "wing", "room", "source_file", "chunk_index", "content")
CLOSET_KEY = ("team_id", "wing", "room", "source_file", "document")


def _absorbable(records: DataFrame, body: str, now: str) -> DataFrame:
    named = records.withColumns({c: trimmed(F.col(c)) for c in ("wing", "room")})
    good = named.where((F.col("wing") != "") & (F.col("room") != "") & (trimmed(F.col(body)) != ""))
    return good.withColumn("filed_at", F.coalesce(F.nullif(trimmed(F.col("filed_at")), F.lit("")), F.lit(now)))


def absorbable_drawers(records: DataFrame, now: str) -> DataFrame:
    """The records that an import takes as drawers, with their ids."""
    return _absorbable(records, "content", now).withColumn("id", ids.drawer_id(*map(F.col, DRAWER_KEY)))


def absorb(drawers: DataFrame, records: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(drawers, one row with the rows taken) after an import: contents verbatim, blank wings, rooms or contents left out, what
    waits for a vector or has one unchanged."""
    good = absorbable_drawers(records, now)
    return keep_latest(drawers, good, ["team_id", "id"], keep=("embedded_at",), order=("filed_at",)), good.agg(F.count("*").alias("taken"))


def absorb_closets(closets: DataFrame, records: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The same for closets (their text is `document`); an id is made of the document, so a repeated import changes nothing."""
    good = _absorbable(records, "document", now)
    good = good.withColumn("id", ids.closet_id(*map(F.col, CLOSET_KEY)))
    return keep_latest(closets, good, ["team_id", "id"], keep=("embedded_at",), order=("filed_at",)), good.agg(F.count("*").alias("taken"))


def closets_by(closets: DataFrame, team: str, wing: str | None = None, source: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """A team's closets of a wing, of a source or with the ids of wanted."""
    own = closets.where(F.col("team_id") == team)
    for column, value in (("wing", wing), ("source_file", source)):
        own = own.where(F.col(column) == value) if value is not None else own
    return by_ids(own, wanted) if wanted is not None else own


def copy_wing(rows: DataFrame, vectors: DataFrame, from_team: str, to_team: str, wing: str, closets: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, vectors, counts) that a copy of a wing's drawers, or its closets, brings to another team: new ids, no parents,
    vectors reused; rows without a vector are skipped and counted. The vectors of closets are in a namespace of their own."""
    if not from_team or not to_team or from_team == to_team:
        raise ValueError("two different teams are needed")
    space, key, make = ("::closets", CLOSET_KEY, ids.closet_id) if closets else ("", DRAWER_KEY, ids.drawer_id)
    own = rows.where((F.col("team_id") == from_team) & (F.col("wing") == wing)).withColumnRenamed("id", "old_id")
    have = vectors.where(F.col("namespace") == from_team + space).select(F.col("id").alias("old_id"), "vec")
    both = own.join(have, "old_id", "left").withColumn("team_id", F.lit(to_team))
    both = both.withColumn("id", make(*map(F.col, key)))
    both = both.withColumn("parent_id", F.lit("")) if "parent_id" in both.columns else both
    found = both.where("vec is not null")
    counts = both.agg(F.count("vec").alias("copied"), F.count_if(F.col("vec").isNull()).alias("skipped"))
    return found.drop("vec", "old_id"), found.select(F.lit(to_team + space).alias("namespace"), "id", "vec"), counts


def merge_wings(rows: DataFrame, sources: list[str], target: str) -> DataFrame:
    """rows with the wings of sources (but target) named target; ids stay."""
    moved = [s for s in sources if s != target]
    return rows.withColumn("wing", F.when(F.col("wing").isin(moved), F.lit(target)).otherwise(F.col("wing"))) if moved else rows


def wing_duplicates(drawers: DataFrame) -> DataFrame:
    """(wing, duplicate, drawers, duplicate_drawers): pairs X and wing_X."""
    counts = drawers.groupBy("wing").agg(F.count("*").alias("drawers"))
    long = counts.where(F.col("wing").startswith("wing_") & (F.length("wing") > 5)).select(F.col("wing").alias("duplicate"), F.substr("wing", F.lit(6)).alias("wing"), F.col("drawers").alias("duplicate_drawers"))
    return counts.join(long, "wing").select("wing", "duplicate", "drawers", "duplicate_drawers")


def write_journal(entries: DataFrame) -> DataFrame:
    """Rows of entries (team_id, agent, topic, wing, content, filed_at, seed): agents in lower case, strides of the text; the
    seed (a time and a nonce) keeps repeated entries apart."""
    agent = F.lower(trimmed(F.col("agent")))
    filled = entries.withColumns({"agent": agent, "topic": F.coalesce(F.nullif(trimmed(F.col("topic")), F.lit("")), F.lit("general"))})
    filled = filled.withColumns({"wing": F.coalesce(F.nullif(trimmed(F.col("wing")), F.lit("")), F.concat(F.lit("wing_"), "agent")), "room": F.lit("diary")})
    cut = stride_chunks(filled, "content").drop("content").withColumnRenamed("chunk", "content")
    return cut.withColumn("id", ids.journal_id(*(F.col(c) for c in ("team_id", "wing", "agent", "topic", "chunk_index", "content", "seed"))))


def read_journal(journal: DataFrame, agent: str, wing: str | None = None, last: int = 10) -> DataFrame:
    """The newest rows of an agent's journal with the total of all (n 1 to 100, else 10)."""
    last = last if 1 <= last <= 100 else 10 if last < 1 else 100
    own = journal.where(F.col("agent") == agent.strip().lower())
    own = own.where(F.col("wing") == wing) if wing else own
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(F.desc("filed_at"), "id").limit(last).join(F.broadcast(total))  # one row


def embed_pending(rows: DataFrame, embedder: Column, now: str, team: str, batch: int = 64, closets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vectors, rows stamped) of a team's oldest drawers, or closets, without a vector."""
    due = rows.where((F.col("team_id") == team) & F.col("embedded_at").isNull()).orderBy("filed_at", "id").limit(batch)
    space = F.concat(F.col("team_id"), F.lit("::closets")) if closets else F.col("team_id")
    return due.select(space.alias("namespace"), "id", embedder.alias("vec")), due.withColumn("embedded_at", F.lit(now))


def embed_all_pending(rows: DataFrame, embedder: Column, now: str, batch: int = 64, closets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vectors, rows stamped) of one cycle over all teams: the oldest rows of each, batch at most."""
    oldest = Window.partitionBy("team_id").orderBy("filed_at", "id")
    due = rows.where(F.col("embedded_at").isNull()).withColumn("__n", F.row_number().over(oldest)).where(F.col("__n") <= batch).drop("__n")
    space = F.concat(F.col("team_id"), F.lit("::closets")) if closets else F.col("team_id")
    return due.select(space.alias("namespace"), "id", embedder.alias("vec")), due.withColumn("embedded_at", F.lit(now))


def valid_tunnels(new: DataFrame, drawers: DataFrame) -> DataFrame:
    """The rows of new (source_wing, source_room, target_wing, target_room) whose names are valid and whose rooms exist."""
    ends = [F.col(c) for c in ("source_wing", "source_room", "target_wing", "target_room")]
    good = new.where(valid_name(ends[0]) & valid_name(ends[1]) & valid_name(ends[2]) & valid_name(ends[3]))
    there = drawers.select("wing", "room").distinct()
    for side in ("source", "target"):
        good = good.join(there.select(F.col("wing").alias(f"{side}_wing"), F.col("room").alias(f"{side}_room")), [f"{side}_wing", f"{side}_room"], "left_semi")
    return good


def upsert_tunnels(tunnels: DataFrame, new: DataFrame, drawers: DataFrame, now: str) -> DataFrame:
    """tunnels with those of new (source_wing, source_room, target_wing, target_room, label) whose names are valid and rooms
    exist; one that is there, in either direction, gets the new label and time only."""
    ends = [F.col(c) for c in ("source_wing", "source_room", "target_wing", "target_room")]
    rows = valid_tunnels(new, drawers).withColumns({"id": ids.tunnel_id(*ends), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return keep_latest(tunnels, rows, ["id"], keep=tuple(c for c in tunnels.columns if c not in ("id", "label", "updated_at")))
