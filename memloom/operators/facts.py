"""Facts that hold for a time: who, what, whom, from when to when. '' is an open bound; both bounds are inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ids import entity_id, predicate_id, triple_id
from memloom.functions.text import fits, temporal, trimmed, valid_fact_value

MOST_TIMELINE = 100


def start_key(value: Column) -> Column:
    return F.when(F.length(value) == 10, F.concat(value, F.lit("T00:00:00Z"))).otherwise(value)


def end_key(value: Column) -> Column:
    return F.when(F.length(value) == 10, F.concat(value, F.lit("T23:59:59Z"))).otherwise(value)


def in_effect(as_of: str | Column, valid_from: Column = None, valid_to: Column = None) -> Column:
    """Whether a fact holds at as_of; a day stands for its first second."""
    begin, end = (F.col("valid_from") if valid_from is None else valid_from), (F.col("valid_to") if valid_to is None else valid_to)
    at = start_key(as_of if isinstance(as_of, Column) else F.lit(as_of))
    return ((begin == "") | (start_key(begin) <= at)) & ((end == "") | (end_key(end) >= at))


def normalised(facts: DataFrame) -> DataFrame:
    """facts with subject_id, predicate_id and object_id, which `query`, `timeline` and `invalidate` compare where they are there: a
    table stored with them, sorted or partitioned by them, is pruned by its statistics instead of read whole."""
    return facts.withColumns({"subject_id": entity_id(F.col("subject")), "predicate_id": predicate_id(F.col("predicate")), "object_id": entity_id(F.col("object"))})


def _names(facts: DataFrame, column: str, name: str) -> Column:
    """Whether a row's subject, predicate or object goes by name."""
    ident = predicate_id if column == "predicate" else entity_id
    return (F.col(f"{column}_id") if f"{column}_id" in facts.columns else ident(F.col(column))) == ident(F.lit(name))


def entities(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(entity_id, name): the entities of facts by the first name seen, or of names (entity_id, name). Facts go by
    recorded_at, where they have it, and id; of a fact the subject is seen before the object."""
    if names is not None:
        return names
    seen = [F.col(c) for c in ("recorded_at", "id") if c in facts.columns]
    each = facts.select(F.posexplode(F.array("subject", "object")).alias("side", "name"), F.struct(*seen).alias("seen"))
    return each.groupBy(entity_id(F.col("name")).alias("entity_id")).agg(F.min_by("name", F.struct("seen", "side", "name")).alias("name"))


def with_names(triples: DataFrame, names: DataFrame) -> DataFrame:
    """triples (subject_id, object_id, ...) with subject and object from names (entity_id, name); '' where there is none."""
    out = triples
    for side in ("subject", "object"):
        out = out.join(names.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"__{side}")), f"{side}_id", "left").withColumn(side, F.coalesce(f"__{side}", F.lit(""))).drop(f"__{side}")
    return out


def query(facts: DataFrame, entity: str, as_of: str | None = None, direction: str = "outgoing") -> DataFrame:
    """(direction, subject, predicate, object, valid_from, valid_to, current): facts about an entity, outgoing before incoming;
    the asked side has the caller's spelling."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction is outgoing, incoming or both")
    parts = []
    for side, column in (("outgoing", "subject"), ("incoming", "object")):
        if direction in (side, "both"):
            own = facts.where(_names(facts, column, entity)).withColumn(column, F.lit(entity))
            parts.append(own.select(F.lit(side).alias("direction"), "subject", predicate_id(F.col("predicate")).alias("predicate"), "object", "valid_from", "valid_to", (F.col("valid_to") == "").alias("current")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.where(in_effect(as_of)) if as_of else found


#: Days that are told apart, from FIRST_DAY on; a power of two. Earlier and later ones count as the first and the last of them.
DAYS, FIRST_DAY = 1 << 17, "1800-01-01"


def _day(value: Column, unbounded: int) -> Column:
    number = F.datediff(F.to_date(F.substring(value, 1, 10)), F.to_date(F.lit(FIRST_DAY)))
    return F.when(value == "", F.lit(unbounded)).otherwise(F.greatest(F.lit(0), F.least(F.lit(DAYS - 1), number)))


def _covering(first: Column, last: Column) -> Column:
    """The fewest nodes of a binary tree over the days that make up first .. last; there are two of a size at most."""

    def step(s: Column, _: Column) -> Column:
        low, high = s["low"], s["high"]
        left = F.when((low < high) & (low % 2 == 1), F.array(low)).otherwise(F.array().cast("array<int>"))
        right = F.when((low < high) & (high % 2 == 1), F.array(high - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(((low + 1) / 2).cast("int").alias("low"), (high / 2).cast("int").alias("high"), F.concat(s["nodes"], left, F.filter(right, lambda n: ~F.array_contains(left, n))).alias("nodes"))

    begin = F.struct((first + DAYS).cast("int").alias("low"), (last + DAYS + 1).cast("int").alias("high"), F.array().cast("array<int>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DAYS.bit_length())), begin, step, lambda s: s["nodes"])


def in_effect_for(facts: DataFrame, questions: DataFrame, side: str = "subject") -> DataFrame:
    """(question_id, and the columns of facts): for each of any number of questions (question_id, entity, as_of) the facts with that
    entity on a side that hold then. A fact is dealt to the nodes of a tree of days that make up its time, a question to the nodes
    above its day, and they meet in one node at most: an equi-join on entity and node, which also parts the facts of a hot
    entity by time. The bounds themselves are asked last. A null or ill-formed as_of has no facts."""
    at = temporal(F.col("as_of"))
    asked = questions.where(at.isNotNull() & (at != "")).select("question_id", entity_id(F.col("entity")).alias("__e"), at.alias("__at"))
    above = F.transform(F.sequence(F.lit(0), F.lit(DAYS.bit_length() - 1)), lambda k: F.floor((_day(F.col("__at"), 0) + DAYS) / F.pow(F.lit(2.0), k)).cast("int"))
    asked = asked.withColumn("__n", F.explode(above))
    name = F.col(f"{side}_id") if f"{side}_id" in facts.columns else entity_id(F.col(side))
    known = facts.withColumns({"__e": name, "__n": F.explode(_covering(_day(F.col("valid_from"), 0), _day(F.col("valid_to"), DAYS - 1)))})
    # merged: sizes are guessed from before the nodes, some ten times too small, so a side that isn't small would be broadcast through the driver
    return asked.join(known.hint("merge"), ["__e", "__n"]).where(in_effect(F.col("__at"))).select("question_id", *facts.columns)


def timeline(facts: DataFrame, entity: str | None = None) -> DataFrame:
    """The first MOST_TIMELINE facts (of an entity, on either side) by start, undated ones last."""
    kept = facts
    if entity is not None:
        kept = facts.where(_names(facts, "subject", entity) | _names(facts, "object", entity))
    return kept.orderBy(F.col("valid_from") == "", "valid_from", "id").limit(MOST_TIMELINE)


def stats(facts: DataFrame) -> DataFrame:
    """One row: entities, facts, current ones, the rest, and the predicates by name."""
    names = facts.select(F.explode(F.array(entity_id(F.col("subject")), entity_id(F.col("object")))).alias("e")).agg(F.count_distinct("e").alias("entities"))
    rest = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to") == "").alias("current"), F.count_if(F.col("valid_to") != "").alias("expired"), F.array_join(F.sort_array(F.collect_set(predicate_id(F.col("predicate")))), ",").alias("predicates"))
    return names.join(F.broadcast(rest))  # one row each


def valid(facts: DataFrame) -> Column:
    """Whether a fact may be stored: values and bounds well formed, and no end before its start."""
    return valid_fact_value(F.col("subject")) & valid_fact_value(F.col("predicate")) & valid_fact_value(F.col("object")) & _in_order(temporal(F.col("valid_from")), temporal(F.col("valid_to")))


def _in_order(begin: Column, end: Column) -> Column:
    """Whether both bounds are well formed and the end isn't before the start."""
    return begin.isNotNull() & end.isNotNull() & ((begin == "") | (end == "") | (end_key(end) >= start_key(begin)))


def add(stored: DataFrame, new: DataFrame, recorded_at: str) -> DataFrame:
    """stored facts and those of new (subject, predicate, object, valid_from, valid_to) that are valid and whose triple has no
    current fact yet, whatever its start. The new facts of a triple are taken ended ones first, by start: all that have ended stay
    (of equal starts the first to end, as an id is made of the start), and of the current ones the first."""
    triple, spelled = ["__s", "__p", "__o"], ["subject", "predicate", "object"]
    key = [entity_id(F.col("__t.subject")), predicate_id(F.col("__t.predicate")), entity_id(F.col("__t.object"))]
    # what is costly is found once for a fact: what reads the results of explode isn't joined with what they are made of, which
    # would else be found again for every condition
    once = lambda *parts: F.explode(F.array(F.struct(*parts)))
    trims = once(*(trimmed(F.col(c)).alias(c) for c in (*spelled, "valid_from", "valid_to")))
    rows = new.select(*spelled, F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"), trims.alias("__t"))
    rows = rows.where(fits(F.col("__t.subject")) & fits(F.col("__t.predicate")) & fits(F.col("__t.object")))
    rows = rows.select(*spelled, "__t", once(temporal(F.col("__from"), F.col("__t.valid_from")).alias("begin"), temporal(F.col("__to"), F.col("__t.valid_to")).alias("end")).alias("__f"))
    rows = rows.where(_in_order(F.col("__f.begin"), F.col("__f.end")))
    names = F.struct("subject", "predicate", "object")
    over = F.col("__f.end") != ""
    each = rows.groupBy(*(c.alias(name) for c, name in zip(key, triple, strict=True)), F.col("__f.begin").alias("valid_from")).agg(F.min(F.when(over, F.struct(F.col("__f.end").alias("valid_to"), names.alias("names")))).alias("ended"), F.min(F.when(~over, names)).alias("opened"))
    # facts that are current meet the new ones of their triple in one shuffle; a start has one row, so few rows share a triple
    now = stored.where("valid_to = ''").select(once(*(trimmed(F.col(c)).alias(c) for c in spelled)).alias("__t")).select(*(c.alias(name) for c, name in zip(key, triple, strict=True)), F.lit(True).alias("current"))
    same = Window.partitionBy(*triple)
    first = F.min(F.when(F.col("opened").isNotNull(), F.col("valid_from"))).over(same)
    each = each.unionByName(now.distinct(), allowMissingColumns=True).withColumns({"first": first, "current": F.max("current").over(same)})
    fresh = each.where(F.col("current").isNull() & (F.col("ended").isNotNull() | (F.col("valid_from") == F.col("first"))))
    fresh = fresh.withColumn("names", F.coalesce("ended.names", "opened"))
    return stored.unionByName(fresh.select(triple_id(F.col("__s"), F.col("__p"), F.col("__o"), F.col("valid_from"), F.lit(recorded_at)).alias("id"), "names.*", "valid_from", F.coalesce("ended.valid_to", F.lit("")).alias("valid_to")))


def invalidate(stored: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    """stored with the current facts of the triple ended; an end before a start is an error."""
    match = _names(stored, "subject", subject) & _names(stored, "predicate", predicate) & _names(stored, "object", object_) & (F.col("valid_to") == "")
    early = match & (F.col("valid_from") != "") & (end_key(F.lit(ended)) < start_key(F.col("valid_from")))
    return stored.withColumn("valid_to", F.when(early, F.raise_error(F.lit("a fact can't end before it starts"))).when(match, F.lit(ended)).otherwise(F.col("valid_to")))
