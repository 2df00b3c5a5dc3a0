"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words;
a target stops at EPOCHS times its source's words and the excess is shared again by weight.

Order: within a source, documents go by the MD5 of id and text, so reruns agree. A source's words
are taken whole as often as they fit, then once more up to a threshold key near the target.

Positions: each source has a schedule, a piecewise linear weight over training time 0 to 1. Its
integral, scaled to what the source gives, is the demand; a copy whose words begin after c words of
its source stands where the demand reaches c plus half its size. Documents are range-sorted by the
position of their first copy.

Defined cases: null text has no words; null is a source of its own; rows that repeat id and text
share a key and are taken alike; sources without words take none; documents that aren't taken have
no position and come last; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import WORD, stored

CYCLE, EPOCHS = (1, 2, 3), 3
#: Weight over time for the sources of each place in the cycle, as (time, weight) knots: early, even and late.
SCHEDULES = (((0.0, 3.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))
#: Leading digits of the key that cut a source's running sum into pieces.
PIECE_DIGITS = 3


def order_key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key) of every row."""
    key = order_key(id_col, text_col)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, place, source_size, target): one row for each source; the windows run over that small table."""
    whole = Window.partitionBy()
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    total = total.select("source", "source_size", rank.alias("rank")).withColumn("place", F.col("rank") % len(CYCLE))
    weighed = total.withColumn("w", F.element_at(F.array(*map(F.lit, CYCLE)), F.col("place") + 1))
    # sources reach their stop in the order of words for each unit of weight; share: words for each unit once all before have stopped
    order = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    stopped = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = weighed.withColumn("share", (F.sum("source_size").over(whole) - EPOCHS * stopped).cast("double") / left)
    free = F.col("source_size") * EPOCHS >= F.col("share") * F.col("w")
    settled = shared.withColumn("settled", F.min(F.when(free, F.struct(F.col("source_size") / F.col("w"), F.col("rank"), F.col("share")))).over(whole)["share"])
    target = F.least(F.col("settled") * F.col("w"), (F.col("source_size") * EPOCHS).cast("double"))
    return settled.select("source", "place", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start, length, weight at start, slope, demand at start) of each linear piece, with a whole demand of 1."""
    pieces = list(zip(knots, knots[1:], strict=False))
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces)
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in pieces:
        out.append((t0, t1 - t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, done))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def _invert(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time at which the schedule's demand reaches share (0 to 1)."""
    out = None
    for t0, length, w, slope, done in _segments(knots):
        need = share - F.lit(done)
        # w * t + slope / 2 * t * t = need
        t = need / F.lit(w) if slope == 0 else need * 2.0 / (F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * need)))
        here = F.lit(t0) + F.least(F.greatest(t, F.lit(0.0)), F.lit(length))
        out = here if out is None else F.when(share >= F.lit(done), here).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple = SCHEDULES) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, copies, taken, positions, position) of every row, range-sorted by
    position, the first of positions; positions has one time for each copy."""
    placed = _placed(stored(measured(docs, id_col, text_col, source_col), "sizes"))
    given = F.col("source_size") * F.col("full") + F.col("extra_words")

    def times(round_: Column) -> Column:
        share = (round_ * F.col("source_size") + F.col("before") + F.col("size") / 2) / given
        at = F.lit(None).cast("double")
        for place, knots in enumerate(schedules):
            at = F.when(F.col("place") == place, _invert(knots, share)).otherwise(at)
        return at

    positions = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), times))
    out = placed.select("doc_id", "source", "key", "size", "source_size", "target", "copies", "taken", positions.alias("positions"))
    return out.withColumn("position", F.get("positions", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "key")


def _placed(sizes: DataFrame) -> DataFrame:
    """Every row of sizes with its source's figures, the words of its source before it, and whether the last, partial round takes it."""
    sizes = sizes.withColumn("piece", F.substring("key", 1, PIECE_DIGITS))
    pieces = sizes.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    facts = source_targets(sizes).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    known = pieces.withColumnRenamed("source", "s").join(facts, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    known = known.select(F.col("source").alias("s"), F.col("piece").alias("p"), "ahead", "place", "source_size", "target", "full", "rest")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p"))).drop("s", "p")
    inside = Window.partitionBy("source", "piece").orderBy("key")  # equal keys are peers: they are taken together
    rows = rows.withColumn("till", F.col("ahead") + F.sum("size").over(inside)).withColumn("own", F.sum("size").over(Window.partitionBy("source", "piece", "key")))
    rows = rows.withColumn("extra", (F.col("till") * 2 - F.col("own")).cast("double") <= F.col("rest") * 2)
    last = rows.where("extra").groupBy("source").agg(F.max("till").alias("extra_words")).withColumnRenamed("source", "s")
    rows = rows.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("extra_words", F.coalesce("extra_words", F.lit(0)))
    copies = F.col("full") + F.when(F.col("extra") & (F.col("full") < EPOCHS), 1).otherwise(0)
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).withColumn("before", F.col("till") - F.col("own"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: every row once for each of the positions that `mix` gives it, range-sorted by position, so
    rows that it doesn't take are gone; taken rows without words have no position and come last."""
    spots = mix(docs, id_col, text_col, source_col).where("copies > 0").dropDuplicates(["source", "key"])  # equal keys are taken alike
    at = F.coalesce("positions", F.array_repeat(F.lit(None).cast("double"), F.col("copies").cast("int")))
    spots = spots.select("source", "key", at.alias("at"))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no name of docs meets one of these
    own_id, own_text, own_source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    rows = plain.withColumn("row_key", order_key(own_id, own_text)).join(spots, (F.col("row_key") == F.col("key")) & F.col(own_source).eqNullSafe(F.col("source")))
    rows = rows.select(*plain.columns, "row_key", F.explode("at").alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "row_key").select(*plain.columns).toDF(*names)
