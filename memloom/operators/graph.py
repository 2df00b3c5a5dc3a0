"""The graph of rooms and wings, the hallways of entities that occur together, and tunnels between wings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ids import hallway_id, tunnel_id
from memloom.sources.buckets import BucketTable
from memloom.sources.shared import kept

LEAST_TOGETHER, MOST_NODES, TOP_TUNNELS, MOST_HOPS, USUAL_HOPS = 2, 50, 10, 10, 2


def room_wings(drawers: DataFrame) -> DataFrame:
    """(room, wing, drawers, recent) without blank names and the general room."""
    kept = drawers.where("wing <> '' and room <> '' and room <> 'general'")
    return kept.groupBy("room", "wing").agg(F.count("*").alias("drawers"), F.max("content_date").alias("recent"))


def nodes(drawers: DataFrame) -> DataFrame:
    """(room, wings, drawers, recent): each room with its sorted wings."""
    return room_wings(drawers).groupBy("room").agg(F.sort_array(F.collect_set("wing")).alias("wings"), F.sum("drawers").alias("drawers"), F.max("recent").alias("recent"))


def find_tunnels(drawers: DataFrame, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
    """Rooms of two wings or more, the largest first."""
    found = nodes(drawers).where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        found = found.where(F.array_contains("wings", wing)) if wing else found
    return found.orderBy(F.desc("drawers"), "room").limit(MOST_NODES)


def graph_stats(drawers: DataFrame) -> DataFrame:
    """One row: rooms, rooms of several wings, edges (wing pairs of each such room), and the widest such rooms."""
    all_nodes = nodes(drawers).withColumn("n", F.size("wings"))
    totals = all_nodes.agg(F.count("*").alias("rooms"), F.count_if(F.col("n") >= 2).alias("tunnel_rooms"), F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("edges"))
    top = all_nodes.where("n >= 2").orderBy(F.desc("n"), F.desc("drawers"), "room").limit(TOP_TUNNELS)
    listed = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.col("drawers")).alias("b"), "room"))), lambda x: x["room"]), ",").alias("top_tunnels"))
    return totals.join(F.broadcast(listed))  # one row each


def rooms_per_wing(drawers: DataFrame) -> DataFrame:
    return room_wings(drawers).groupBy("wing").agg(F.count("*").alias("rooms"))


def traverse(drawers: DataFrame, start: str, hops: int = USUAL_HOPS) -> DataFrame:
    """(room, wings, drawers, hop, connected_via): rooms within hops of start, rooms that share a wing being next to each
    other; connected_via are the wings shared with the first parent in the order of the walk. One equi-join a hop
    against what was not seen before; each hop is cut off."""
    hops = MOST_HOPS if hops > MOST_HOPS else hops if hops > 0 else USUAL_HOPS
    spark = drawers.sparkSession
    graph = kept(nodes(drawers))
    if graph.where(F.col("room") == start).isEmpty():
        raise ValueError(f"room {start!r} not found")
    by_wing = graph.select("room", F.explode("wings").alias("wing"))
    # the walk's order, parents in their order and then rooms by name, is that of the paths of rooms, at most MOST_HOPS long
    seen = spark.createDataFrame([(start, 0, [])], "room string, hop int, place array<string>").withColumn("via", F.lit(None).cast("array<string>"))
    frontier = seen
    for hop in range(1, hops + 1):
        # of a wing only the first room of the frontier can be the first parent of another, so a hop is linear in the places
        first = frontier.select("room", "place").join(by_wing, "room").groupBy("wing").agg(F.min("place").alias("place"))
        steps = by_wing.join(first, "wing").join(seen.select("room"), "room", "left_anti")
        shared = steps.groupBy("room", "place").agg(F.sort_array(F.collect_set("wing")).alias("via"))
        parent = shared.groupBy("room").agg(F.min(F.struct("place", "via")).alias("p"))
        frontier = kept(parent.select("room", F.lit(hop).alias("hop"), F.concat("p.place", F.array("room")).alias("place"), F.col("p.via").alias("via")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return graph.join(seen, "room").select("room", "wings", "drawers", "hop", F.coalesce("via", F.array().cast("array<string>")).alias("connected_via")).orderBy("hop", F.desc("drawers"), "room").limit(MOST_NODES)


def entity_pairs(drawers: DataFrame, *more: str) -> DataFrame:
    """(wing, room, entity_a, entity_b, and more columns) of every two entities of a drawer, which has a few tens at most."""
    entities = F.sort_array(F.array_distinct(F.filter("entities", lambda e: F.trim(e) != "")))
    own = drawers.select("wing", "room", *more, entities.alias("e")).where(F.size("e") >= 2)
    firsts = own.select("wing", "room", *more, "e", F.posexplode("e").alias("i", "entity_a"))
    return firsts.select("wing", "room", *more, "entity_a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("entity_b"))


def _described(found: DataFrame) -> DataFrame:
    label = F.concat("entity_a", F.lit(" ↔ "), "entity_b", F.lit(" (co-occur in "), F.col("together").cast("string"), F.lit(" drawers across "), F.size("rooms").cast("string"), F.lit(" rooms: "), F.array_join("rooms", ", "), F.lit(")"))
    return found.withColumns({"id": hallway_id(F.col("wing"), F.col("entity_a"), F.col("entity_b")), "label": label})


def hallways(drawers: DataFrame, prior: DataFrame | None = None, now: str = "") -> DataFrame:
    """(wing, entity_a, entity_b, together, rooms, id, label, ...): pairs of entities in LEAST_TOGETHER drawers or more of a
    wing. A pair that was in prior (wing, entity_a, entity_b, strength, stability, last_active, uses) keeps those figures."""
    found = entity_pairs(drawers).groupBy("wing", "entity_a", "entity_b").agg(F.count("*").alias("together"), F.sort_array(F.collect_set(F.nullif("room", F.lit("")))).alias("rooms")).where(F.col("together") >= LEAST_TOGETHER)
    found = _described(found)
    start = {"strength": F.lit(1.0), "stability": F.lit(1.0), "last_active": F.lit(now), "uses": F.lit(0).cast("long")}
    if prior is None:
        return found.withColumns(start)
    old = prior.select("wing", F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b"), *(F.col(c).alias("__" + c) for c in start))
    joined = found.join(old, ["wing", "entity_a", "entity_b"], "left")
    return joined.withColumns({c: F.coalesce("__" + c, v) for c, v in start.items()}).drop(*("__" + c for c in start))


#: A maintained table of pairs: how many drawers of a room hold both entities.
PAIR, PAIR_COUNTS = ["wing", "entity_a", "entity_b"], "wing string, entity_a string, entity_b string, room string, n long"


def pair_table(spark: SparkSession, path: str, buckets: int = 256) -> BucketTable:
    """An empty table of pairs, a pair's rooms in one bucket."""
    return BucketTable.create(spark, path, spark.createDataFrame([], PAIR_COUNTS).schema, [*PAIR, "room"], buckets, by=PAIR)


def apply_drawers(table: BucketTable, batch: str, added: DataFrame, removed: DataFrame | None = None) -> int:
    """Takes drawers (wing, room, entities) that came and went into a table of pairs, once for each batch; only the buckets of
    their pairs are read and written. Drawers that are removed have to be there. Returns the version."""
    signed = added.select("wing", "room", "entities", F.lit(1).alias("sign"))
    if removed is not None:
        signed = signed.unionByName(removed.select("wing", "room", "entities", F.lit(-1).alias("sign")))
    sums = lambda rows: rows.groupBy(*PAIR, "room").agg(F.sum("n").alias("n")).where("n <> 0")
    deltas = sums(entity_pairs(signed, "sign").select(*PAIR, F.coalesce("room", F.lit("")).alias("room"), F.col("sign").cast("long").alias("n")))

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        checked = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a drawer that isn't there was removed")).cast("long"))
        return sums(old.unionByName(new)).withColumn("n", checked)

    return table.change(batch, deltas, change)


def maintained_hallways(pairs: DataFrame) -> DataFrame:
    """The hallways of a table of pairs, or of some of its buckets: what `hallways` gives for the drawers that are there."""
    rooms = F.sort_array(F.collect_set(F.nullif("room", F.lit(""))))
    return _described(pairs.groupBy(*PAIR).agg(F.sum("n").alias("together"), rooms.alias("rooms")).where(F.col("together") >= LEAST_TOGETHER))


def entity_tunnels(halls: DataFrame) -> DataFrame:
    """(id, source_wing, target_wing, room, label): one for each entity and unordered pair of wings where it has hallways."""
    where = halls.select("wing", F.explode(F.array("entity_a", "entity_b")).alias("entity")).distinct()
    other = where.withColumnRenamed("wing", "target_wing")
    pairs = where.withColumnRenamed("wing", "source_wing").join(other, "entity").where("source_wing < target_wing")
    room = F.concat(F.lit("entity:"), "entity")
    return pairs.select(tunnel_id(F.col("source_wing"), room, F.col("target_wing"), room).alias("id"), "source_wing", "target_wing", room.alias("room"), F.concat(F.lit("shared entity: "), "entity").alias("label"))


def recompute(drawers: DataFrame, stored: DataFrame, wing: str | None = None, prune: bool = False, now: str = "") -> tuple[DataFrame, DataFrame]:
    """(hallways, entity tunnels) after a rebuild of one wing or all; stored hallways of other wings stay, of wings
    without drawers only if not pruned; tunnels come from all hallways."""
    present = drawers.select("wing").distinct()
    if wing and present.where(F.col("wing") == wing).isEmpty():
        raise ValueError(f"wing {wing!r} has no drawers")
    targets = present.where(F.col("wing") == wing) if wing else present
    fresh = hallways(drawers.join(targets, "wing", "left_semi"), stored, now)
    rest = stored.join(targets, "wing", "left_anti")
    rest = rest.limit(0) if prune and not wing else rest
    halls = fresh.unionByName(rest, allowMissingColumns=True)
    return halls, entity_tunnels(halls)


def replace_wing(halls: DataFrame, wing: str, fresh: DataFrame) -> DataFrame:
    """halls with those of a wing replaced by fresh, which may be empty."""
    return halls.where(F.col("wing") != wing).unionByName(fresh, allowMissingColumns=True)


def delete_by_id(rows: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """(hallways or tunnels without one, one row that says whether it existed)."""
    hit = F.col("id") == id_
    return rows.where(~hit), rows.agg(F.coalesce(F.max(hit), F.lit(False)).alias("existed"))


def delete_kind(tunnels: DataFrame, kind: str) -> DataFrame:
    """tunnels without those of a kind, so that derived ones can be built anew and explicit ones stay."""
    return tunnels.where(F.col("kind") != kind)


def tunnel_views(tunnels: DataFrame) -> DataFrame:
    """Tunnels as they go to the caller: ends as structs, without the team, blank optional fields as nulls; a tunnel that was
    never used has the figures that it begins with."""
    have = set(tunnels.columns)
    end = lambda side: F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("wing", "room")), F.nullif(f"{side}_drawer_id", F.lit("")).alias("drawer_id")).alias(side)
    start = {"strength": F.lit(1.0), "stability": F.lit(1.0), "last_active": F.lit(""), "uses": F.lit(0).cast("long"), "updated_at": F.lit("")}
    now = {c: F.col(c) if c in have else v for c, v in start.items()}
    return tunnels.select("id", end("source"), end("target"), "label", "kind", "created_at", F.nullif(now["updated_at"], F.lit("")).alias("updated_at"), now["strength"].alias("strength"), now["stability"].alias("stability"), F.nullif(now["last_active"], F.lit("")).alias("last_activated"), now["uses"].alias("access_count"))


def list_hallways(halls: DataFrame, wing: str | None = None) -> DataFrame:
    return (halls.where(F.col("wing") == wing) if wing else halls).orderBy(F.desc("together"), "id")


def list_tunnels(tunnels: DataFrame, wing: str | None = None) -> DataFrame:
    own = tunnels.where((F.col("source_wing") == wing) | (F.col("target_wing") == wing)) if wing else tunnels
    return own.orderBy(F.desc("created_at"), "id")


def follow_tunnels(tunnels: DataFrame, drawers: DataFrame, wing: str, room: str) -> DataFrame:
    """(direction, wing, room, label, preview): the far ends of tunnels at (wing, room); a tunnel that leaves from there is outgoing."""
    out = (F.col("source_wing") == wing) & (F.col("source_room") == room)
    at = tunnels.where(out | ((F.col("target_wing") == wing) & (F.col("target_room") == room)))
    far = [F.when(out, F.col(f"target_{c}")).otherwise(F.col(f"source_{c}")).alias(c) for c in ("wing", "room", "drawer_id")]
    ends = at.select(F.when(out, "outgoing").otherwise("incoming").alias("direction"), *far, "label")
    return ends.join(drawers.select(F.col("id").alias("drawer_id"), F.substring("content", 1, 300).alias("preview")), "drawer_id", "left").select("direction", "wing", "room", "label", F.coalesce("preview", F.lit("")).alias("preview"))
