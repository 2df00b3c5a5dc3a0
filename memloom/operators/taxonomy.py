"""Counts over drawers: wings, rooms, the tree, what is filed, what is pending, and metering totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wings(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing").agg(F.count("*").alias("drawers"), F.count_distinct("room").alias("rooms"))


def rooms(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    kept = drawers.where(F.col("wing") == wing) if wing else drawers
    return kept.groupBy("wing", "room").agg(F.count("*").alias("drawers"))


def tree(drawers: DataFrame) -> DataFrame:
    """(wing, drawers, rooms): rooms is the wing's list of room:count, by name."""
    each = rooms(drawers)
    return each.groupBy("wing").agg(F.sum("drawers").alias("drawers"), F.array_join(F.sort_array(F.collect_list(F.concat("room", F.lit(":"), F.col("drawers").cast("string")))), ",").alias("rooms"))


def filed_away(drawers: DataFrame) -> DataFrame:
    """One row: drawers, the last filing ('' if none), wings, and names of rooms (not rooms by wing)."""
    return drawers.agg(F.count("*").alias("drawers"), F.coalesce(F.max("filed_at"), F.lit("")).alias("last_filed_at"), F.count_distinct("wing").alias("wings"), F.count_distinct("room").alias("rooms"))


def pending(rows: DataFrame) -> DataFrame:
    """(team_id, pending): rows that wait for a vector."""
    return rows.where("embedded_at is null").groupBy("team_id").agg(F.count("*").alias("pending"))


def teams_with_pending(drawers: DataFrame, closets: DataFrame) -> DataFrame:
    return pending(drawers).select("team_id").union(pending(closets).select("team_id")).distinct()


def oldest_pending(rows: DataFrame, team: str, limit: int = 64) -> DataFrame:
    return rows.where((F.col("team_id") == team) & F.col("embedded_at").isNull()).orderBy("filed_at", "id").limit(limit)


def usage(requests: DataFrame, cap: int) -> DataFrame:
    """(team_id, period, used, remaining): requests admitted a month, the cap at most; no cap (0 or less) has -1 remaining."""
    counted = requests.groupBy("team_id", "period").agg(F.count("*").alias("n"))
    used = F.least(F.col("n"), F.lit(cap)) if cap > 0 else F.col("n")
    return counted.select("team_id", "period", used.cast("long").alias("used"), (F.lit(cap) - used if cap > 0 else F.lit(-1)).cast("long").alias("remaining"))


def status(drawers: DataFrame, used: DataFrame) -> DataFrame:
    """(team_id, drawers, wings, used): an overview of every team."""
    each = drawers.groupBy("team_id").agg(F.count("*").alias("drawers"), F.count_distinct("wing").alias("wings"))
    return each.join(used.groupBy("team_id").agg(F.sum("used").alias("used")), "team_id", "left").select("team_id", "drawers", "wings", F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def admins(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("team_id").agg(F.count_if(F.col("role") == "admin").alias("admins"))


def manifest_total(*parts: DataFrame) -> int:
    """The records that an export holds."""
    return sum(p.count() for p in parts)
