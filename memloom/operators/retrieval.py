"""Retrieval: exact nearest neighbours, BM25 over candidates, their fusion, and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import tokens
from memloom.functions.vectors import cosine, distance, dot, similarity
from memloom.operators.neighbours import CellIndex, nearest_join
from memloom.sources.shared import kept, scratch

K1, B, VECTOR_WEIGHT, TEXT_WEIGHT, POOL_MULTIPLE, FILTERED_POOL = 1.5, 0.75, 0.6, 0.4, 3, 10_000
# The boost of a pointer hit by its rank, and how far it may be.
BOOSTS, BOOST_DISTANCE = (0.40, 0.25, 0.15, 0.08, 0.04), 1.5
MOST_QUERY, MOST_HITS, USUAL_HITS = 250, 100, 5


def nearest(vectors: DataFrame | CellIndex, namespace: str, query: Sequence[float], k: int) -> DataFrame:
    """(id, score, vec_rank): the k best of a namespace by cosine; ties by id. An index of cells gives the same and reads less."""
    if isinstance(vectors, CellIndex):
        return vectors.nearest(namespace, query, k)
    scored = vectors.where(F.col("namespace") == namespace).select("id", cosine(F.col("vec"), F.array(*map(F.lit, map(float, query)))).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(max(0, k))
    return best.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def nearest_units(index: DataFrame, namespace: str, query: Sequence[float], k: int) -> DataFrame:
    """The same from an index of unit vectors (`vectors.unit_index`), so no norm is worked out for a row; scores differ from
    those of the truth by the rounding of unit vectors only."""
    size = sum(float(v) ** 2 for v in query) ** 0.5
    unit = F.array(*(F.lit(float(v) / size if size else 0.0) for v in query))
    own = index.where(F.col("namespace") == namespace).where(F.size("unit") == len(query))
    scored = own.select("id", dot(F.col("unit"), unit).cast("float").alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(max(0, k))
    return best.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def bm25(candidates: DataFrame, query: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, bm25): the candidates' scores, with document frequencies and mean length of the candidates themselves."""
    terms = candidates.sparkSession.range(1).select(F.array_sort(F.array_distinct(tokens(F.lit(query)))).alias("t")).first().t  # a query's terms
    if not terms:
        return candidates.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25"))
    words = candidates.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    wanted = words.select("id", F.size("words").alias("len"), F.filter("words", lambda w: w.isin(*terms)).alias("own"))
    # counted within the row, so texts are read and cut into words once, and what is kept is a few numbers for each
    each = kept(wanted.select("id", "len", *(F.size(F.array_remove(F.col("own"), t)).alias(f"r{k}") for k, t in enumerate(terms)), F.size("own").alias("all")))
    tf = [F.col("all") - F.col(f"r{k}") for k in range(len(terms))]
    facts = each.agg(F.count("*").alias("n"), F.avg(F.col("len").cast("double")).alias("mean"), *(F.count_if(c > 0).alias(f"d{k}") for k, c in enumerate(tf)))

    def part(k: int) -> Column:
        idf = F.ln((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5) + 1)
        return F.when(tf[k] > 0, idf * (tf[k] * (K1 + 1) / (tf[k] + K1 * (1 - B + B * F.col("len") / F.col("mean"))))).otherwise(0.0)

    return each.crossJoin(F.broadcast(facts)).select("id", reduce(add, map(part, range(len(terms)))).alias("bm25"))  # facts are one row


def fuse(hits: DataFrame) -> DataFrame:
    """hits (distance, bm25, boost, vec_rank) with fused scores and rank, best first; ties keep the vectors' order."""
    most = F.max("bm25").over(Window.partitionBy())  # over a pool of candidates
    share = F.when(most > 0, F.col("bm25") / most).otherwise(0.0)
    fused = hits.withColumn("fused", VECTOR_WEIGHT * similarity(F.col("distance")) + TEXT_WEIGHT * share + F.col("boost"))
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), "vec_rank")))


def pointer_boosts(closet_vectors: DataFrame | CellIndex, closets: DataFrame, namespace: str, query: Sequence[float]) -> DataFrame:
    """(source_file, boost): what the nearest pointer documents give to their sources. The first place of a source
    decides; vectors without a document take a place but give nothing."""
    hits = nearest(closet_vectors, namespace, query, len(BOOSTS)).join(closets.select("id", "source_file"), "id")
    first = hits.groupBy("source_file").agg(F.min_by(F.struct("vec_rank", "score"), "vec_rank").alias("h"))
    boost = F.element_at(F.array(*map(F.lit, BOOSTS)), F.col("h.vec_rank"))
    return first.select("source_file", F.when(distance(F.col("h.score")) <= BOOST_DISTANCE, boost).otherwise(0.0).alias("boost"))


def filtered_hits(vectors: DataFrame | CellIndex, drawers: DataFrame, team: str, query: Sequence[float], wing: str | None = None, room: str | None = None, max_distance: float = 0.0, pool: int = FILTERED_POOL) -> DataFrame:
    """The drawers of a team's pool nearest vectors that are in the wing and room and within max_distance (0: any)."""
    hits = nearest(vectors, team, query, pool).join(drawers.where(F.col("team_id") == team), "id").withColumn("distance", distance(F.col("score")))
    for column, value in (("wing", wing), ("room", room)):
        hits = hits.where(F.col(column) == value) if value else hits
    return hits.where(F.col("distance") <= max_distance) if max_distance > 0 else hits


def search(vectors: DataFrame | CellIndex, drawers: DataFrame, team: str, query_text: str, query: Sequence[float], wing: str | None = None, room: str | None = None, limit: int = USUAL_HITS, max_distance: float = 0.0, boosts: DataFrame | None = None, pool_multiple: int = POOL_MULTIPLE, filtered_pool: int = FILTERED_POOL) -> DataFrame:
    """The best drawers of a team for a query. The pool of neighbours is taken first and filtered after, so wing, room and
    distance only ever narrow it; vectors without a row drop out."""
    limit = min(max(1, limit), MOST_HITS)
    hits = filtered_hits(vectors, drawers, team, query, wing, room, max_distance, filtered_pool if wing or room else limit * pool_multiple)
    hits = hits.join(bm25(hits, query_text.strip()[:MOST_QUERY]), "id")
    hits = hits.join(boosts, "source_file", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0))) if boosts is not None else hits.withColumn("boost", F.lit(0.0))
    return fuse(hits).where(F.col("rank") <= limit).select("rank", "id", "wing", "room", "source_file", "vec_rank", "distance", "bm25", "boost", "fused")


def closet_boosts(closet_vectors: DataFrame | CellIndex, closets: DataFrame, team: str, query: Sequence[float]) -> DataFrame:
    """The boosts of a team, whose closets' vectors are in a namespace of their own."""
    return pointer_boosts(closet_vectors, closets.where(F.col("team_id") == team), f"{team}::closets", query)


def hit_views(hits: DataFrame, drawers: DataFrame, team: str) -> DataFrame:
    """Hits of `search` as they go to the caller: the drawer's view and its scores, best first."""
    rows = drawer_views(drawers.where(F.col("team_id") == team))
    scores = hits.select("id", "rank", F.col("fused").alias("score"), F.col("bm25").alias("bm25_score"), F.col("boost").alias("closet_boost"), "distance")
    return rows.join(scores, "id").orderBy("rank")


def drawer_views(drawers: DataFrame) -> DataFrame:
    """Drawers as they go to the caller: without the team, blank optional fields as nulls."""
    own = {c: F.col(c) for c in drawers.columns}
    entities, parent = own.get("entities", F.array().cast("array<string>")), own.get("parent_id", F.lit(""))
    return drawers.select("id", "wing", "room", "source_file", "chunk_index", "content", F.when(F.size(entities) > 0, entities).alias("entities"), F.nullif(parent, F.lit("")).alias("parent_id"), "filed_at", F.nullif("content_date", F.lit("")).alias("content_date"))


def near_duplicate(vectors: DataFrame | CellIndex, drawers: DataFrame, team: str, query: Sequence[float], threshold: float = 0.9) -> DataFrame:
    """One row (id, wing, room, similarity, is_duplicate): the nearest vector, with its drawer if there is one."""
    top = nearest(vectors, team, query, 1).select("id", similarity(distance(F.col("score"))).alias("similarity"))
    rows = drawers.where(F.col("team_id") == team).select("id", "wing", "room")
    return top.join(rows, "id", "left").withColumn("is_duplicate", F.col("similarity") >= min(1.0, max(0.0, threshold)))


def nearest_for_each(queries: DataFrame, vectors: DataFrame | CellIndex) -> DataFrame:
    """(query_id, id, score): the best vector for each of any number of queries (query_id, qvec), ties by id, by an index of cells, which is
    built for the purpose where only vectors are given."""
    index = vectors if isinstance(vectors, CellIndex) else CellIndex.build(vectors, scratch(vectors.sparkSession, "cells"))
    kind = queries.schema["query_id"].dataType
    return nearest_join(queries, index).select(F.col("query_id").cast(kind).alias("query_id"), "id", "score")
