"""Identities: SHA-256 over NUL-ended parts, and the readable ids of graph rows and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ended_digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, each followed by NUL."""
    return F.sha2(F.concat(*[F.concat(p.cast("string"), F.lit("\0")) for p in parts]), 256)


def drawer_id(team: Column, wing: Column, room: Column, source: Column, chunk: Column, content: Column) -> Column:
    return ended_digest(team, wing, room, source, chunk, content)


def journal_id(team: Column, wing: Column, agent: Column, topic: Column, chunk: Column, content: Column, seed: Column) -> Column:
    return ended_digest(team, wing, F.lit("diary"), agent, topic, chunk, content, seed)


def closet_id(team: Column, wing: Column, room: Column, source: Column, last: Column) -> Column:
    """last: the closet's number within its source, or for imports and copies its document."""
    return ended_digest(team, wing, room, source, last)


def hallway_id(wing: Column, a: Column, b: Column) -> Column:
    mark = F.substring(F.sha2(F.concat(wing, F.lit("\0"), a, F.lit("\0"), b), 256), 1, 8)
    return F.concat(F.lit("hallway_"), wing, F.lit("_"), a, F.lit("_"), b, F.lit("_"), mark)


def tunnel_id(wing_a: Column, room_a: Column, wing_b: Column, room_b: Column) -> Column:
    """The same for either direction."""
    x, y = F.concat(wing_a, F.lit("\0"), room_a), F.concat(wing_b, F.lit("\0"), room_b)
    return F.substring(F.sha2(F.concat(F.least(x, y), F.lit("\1"), F.greatest(x, y)), 256), 1, 16)


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_id(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def triple_id(subject: Column, predicate: Column, object_: Column, valid_from: Column, recorded_at: Column) -> Column:
    mark = F.substring(F.sha2(F.concat(valid_from, F.lit("|"), recorded_at), 256), 1, 12)
    return F.concat(F.lit("t_"), subject, F.lit("_"), predicate, F.lit("_"), object_, F.lit("_"), mark)


def collection_name(team: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(team, 256), 1, 16), F.lit("_drawers"))
