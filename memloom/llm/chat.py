"""Multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once, that speaker as the
assistant and all others as named users; masks are the code-point spans of what the assistant
says, with its end mark. Roles in FIXED (the system's) keep their place and never take a turn
as the assistant.

A conversation is rendered in parts of PART_TURNS turns, so no task gathers an unbounded dialogue, however many turns share a
number: the parts of a participant, joined in order, are the whole rendering, and masks are code points of that whole.
Most conversations are one part. Every part has every participant of the whole conversation, with an empty mask where that one is silent. Turns
are numbered by a range sort and the counts of its pieces, so a conversation isn't sorted in one task either.

Defined cases: rows that repeat all of conversation, turn, role and text count once; turns with
the same number go by role and text; turns without a number come first; a null text is empty; a null
role speaks as a user without a name and is no participant; a null conversation is left out; a conversation
of fixed roles only has no participants and no rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import stored

PART_TURNS, FIXED, END = 256, ("system",), "<|end|>\n"
#: Characters of a text that the range sort deals by; texts that share them lie in one piece.
DEALT_CHARS = 64


def _opening(role: Column, perspective: Column) -> Column:
    fixed = role.isin(*FIXED)
    return (
        F.when(role.isNull(), F.lit("<|user|>\n"))
        .when(role == perspective, F.lit("<|assistant|>\n"))
        .when(fixed, F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def numbered(said: DataFrame, part_turns: int) -> DataFrame:
    """said (conv_id, turn, role, text) with the part that each turn is in, by its place in the conversation."""
    dealt = said.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, DEALT_CHARS)).withColumn("piece", F.spark_partition_id())
    dealt = stored(dealt, "turns")  # written, so that the pieces stay as they are
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy("conv_id", "piece").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "text")) - 1
    rows = dealt.withColumn("at", inside).join(pieces.select("conv_id", "piece", "before"), ["conv_id", "piece"])
    return rows.select("conv_id", "turn", "role", "text", F.floor((F.col("before") + F.col("at")) / part_turns).cast("long").alias("part"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, perspective, n_turns, rendered, masks): masks is an array of (start, end) code points of the whole rendering,
    of which rendered is a part."""
    said = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    rows = numbered(said, part_turns)
    speakers = said.where(~F.col("role").isin(*FIXED)).select("conv_id", F.col("role").alias("perspective")).distinct()
    # where each part begins is worked out on numbers alone, so the texts of a long conversation never meet in one task
    as_other = F.length(_opening(F.col("role"), F.lit(None).cast("string")))
    sizes = rows.groupBy("conv_id", "part").agg(F.sum(as_other + F.length("text") + len(END)).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(earlier.partitionBy("conv_id")), F.lit(0)).alias("base"))
    own = rows.where("role is not null").groupBy("conv_id", "part", F.col("role").alias("perspective")).agg(F.count("*").alias("own"))
    places = bases.join(speakers, "conv_id").join(own, ["conv_id", "part", "perspective"], "left")
    # a speaker's own turns open as the assistant's, so they are shorter or longer than as a named user's
    own_before = F.coalesce(F.sum("own").over(earlier.partitionBy("conv_id", "perspective")), F.lit(0))
    change = F.length(_opening(F.col("perspective"), F.col("perspective"))) - F.length(_opening(F.col("perspective"), F.lit(None).cast("string")))
    places = places.select("conv_id", "part", F.struct("perspective", (F.col("base") + own_before * change).alias("from")).alias("place"))
    places = places.groupBy("conv_id", "part").agg(F.collect_list("place").alias("places"))  # the participants
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # part_turns at most
    views = parts.join(places, ["conv_id", "part"]).select("conv_id", "part", "turns", F.explode("places").alias("place")).select("conv_id", "part", "turns", "place.*")
    pieces = F.transform("turns", lambda t: F.struct(_opening(t["role"], F.col("perspective")).alias("opening"), (F.col("perspective").eqNullSafe(t["role"])).alias("own"), F.concat(t["text"], F.lit(END)).alias("body")))
    views = views.withColumn("pieces", pieces)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.col("from").cast("long").alias("at"), none.alias("masks"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["opening"])
        end = begin + F.length(piece["body"])
        mask = F.when(piece["own"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["masks"], mask).alias("masks"))

    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["opening"], p["body"])), "")
    masks = F.aggregate("pieces", start, step, lambda s: s["masks"])
    return views.select("conv_id", "part", "perspective", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), masks.alias("masks"))
