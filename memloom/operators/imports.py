"""Import of a bundle: records go by their kind to the tables that take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import drawers as dw
from memloom.operators import facts as kg
from memloom.operators import graph
from memloom.sources.buckets import BucketTable

DRAWER_KINDS = ("drawer", "diary")


def routed(records: DataFrame, tables: dict[str, DataFrame], team: str, now: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, one row of counts) after records (the columns of `bundles.RECORD`) are taken into a team's drawers, closets,
    facts and tunnels.

    Drawers, diaries and closets are absorbed verbatim; facts are added where they are valid and not yet current; tunnels come last,
    as their rooms must hold drawers by then. What is of no known kind, blank or invalid is counted as skipped. The graph isn't
    rebuilt: see `rebuilt`."""
    own = records.withColumn("team_id", F.lit(team))
    both = own.where(F.col("kind").isin(*DRAWER_KINDS)).withColumns({"chunk_index": F.coalesce("chunk_index", F.lit(0)), **{c: F.coalesce(c, F.lit("")) for c in ("source_file", "content_date")}})
    drawers, taken = dw.absorb(tables["drawers"], both, now)
    closets, taken_closets = dw.absorb_closets(tables["closets"], own.where("kind = 'closet'").withColumn("source_file", F.coalesce("source_file", F.lit(""))), now)
    new = own.where("kind = 'kg'").withColumns({c: F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object", "valid_from", "valid_to")})
    facts = kg.add(tables["facts"], new, now)
    ends = own.where("kind = 'tunnel'").withColumn("label", F.coalesce("label", F.lit("")))
    tunnels = dw.upsert_tunnels(tables["tunnels"], ends, drawers, now)
    counts = taken.withColumnRenamed("taken", "drawers").crossJoin(taken_closets.withColumnRenamed("taken", "closets"))  # one row each, as the next
    counts = counts.crossJoin(new.agg(F.count_if(kg.valid(new)).alias("facts"))).crossJoin(dw.valid_tunnels(ends, drawers).agg(F.count("*").alias("tunnels")))
    total = own.agg(F.count_if(~F.col("kind").eqNullSafe("manifest")).alias("records"))
    counts = counts.crossJoin(total).select("drawers", "closets", "facts", "tunnels", (F.col("records") - F.col("drawers") - F.col("closets") - F.col("facts") - F.col("tunnels")).alias("skipped"))
    return {"drawers": drawers, "closets": closets, "facts": facts, "tunnels": tunnels}, counts


def rebuilt(tables: dict[str, DataFrame], halls: DataFrame, now: str = "") -> tuple[DataFrame, DataFrame]:
    """(hallways, entity tunnels) after an import that asked for it: all wings, none pruned."""
    return graph.recompute(tables["drawers"], halls, now=now)


def absorb_into(table: BucketTable, batch: str, records: DataFrame, now: str) -> int:
    """The rows of `drawers.absorb`, merged into a stored table of drawers once for each batch; only the buckets that they fall in are
    read and written. For streams: in foreachBatch, with a batch named by its number."""
    return table.merge(batch, dw.absorbable_drawers(records, now), keep=("embedded_at",), order=("filed_at",))
