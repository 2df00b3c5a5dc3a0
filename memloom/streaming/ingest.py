"""Streams: bundles that arrive in a folder are merged batch by batch, and requests are metered by month.

Ids are digests and merges go by key, so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.drawers import embed_all_pending
from memloom.sources.bundles import RECORD


def stream_bundles(spark: SparkSession, folder: str, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls merge(rows, batch id) for all that is in the folder and not yet taken, then ends."""
    rows = spark.readStream.schema(RECORD).json(folder)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_merge(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A merge that writes each batch's distinct rows below its id; a repeated batch overwrites itself."""

    def merge(rows: DataFrame, batch: int) -> None:
        rows.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return merge


def merged(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last version of every key over all batches."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*")


def metered(requests: DataFrame) -> DataFrame:
    """(team_id, period, used) of a stream or a table of requests (team_id, ts)."""
    return requests.groupBy("team_id", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("used"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by event time; rows later than late are left out of a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drained(load: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame], None], embedder: Column, now: str, batch: int = 64, closets: bool = False, most_cycles: int = 1_000_000) -> int:
    """Embeds pending rows cycle by cycle, the oldest of every team first, until none is left; returns the cycles that had any.

    load gives the rows as they are now; save takes (vectors, rows stamped) and must store the vectors first, so that what is lost
    in between is embedded again and nothing is stamped without its vector."""
    for cycle in range(most_cycles):
        made, stamped = embed_all_pending(load(), embedder, now, batch, closets)
        if made.isEmpty():
            return cycle
        save(made, stamped)
    return most_cycles


def admitted_batch(requests: DataFrame, used: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(requests with admitted, the new used) for a micro-batch of requests (team_id, period, ts, id) after used (team_id, period,
    used): those beyond the cap are refused and not counted; a cap of 0 or less refuses none."""
    order = Window.partitionBy("team_id", "period").orderBy("ts", "id")
    known = requests.join(used.select("team_id", "period", F.col("used").alias("__used")), ["team_id", "period"], "left")
    place = F.coalesce("__used", F.lit(0)) + F.row_number().over(order)
    marked = known.withColumn("admitted", place <= cap if cap > 0 else F.lit(True)).drop("__used")
    counted = marked.where("admitted").groupBy("team_id", "period").agg(F.count("*").alias("used"))
    return marked, used.unionByName(counted).groupBy("team_id", "period").agg(F.sum("used").alias("used"))
