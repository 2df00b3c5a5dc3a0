"""Pointer lines: what a source is about, its salient entities, and the ids of its first chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import BLANK, LEFT, lowered, stem, trimmed

WINDOW, MOST_TOPICS, MOST_QUOTES, MOST_IDS, PACK_BYTES = 5000, 12, 3, 3, 1500
# Verbs of work.
VERBS = "built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated"
ACTION = rf"(?i){LEFT}((?:{VERBS}){BLANK}+[0-9A-Za-z_\t\n\f\r ]{{3,40}})"
HEADER = rf"(?md)^#{{1,3}}{BLANK}+(.{{5,60}})$"
QUOTE = r'"([^"]{15,150})"'


def locator(content_date: Column, filed_date: Column, line_start: Column, line_end: Column) -> Column:
    """date:Lstart-Lend of the first chunk; '' without a date."""
    date = F.coalesce(F.nullif(content_date, F.lit("")), filed_date, F.lit(""))
    return F.when(date == "", "").otherwise(F.concat(date, F.lit(":L"), line_start.cast("string"), F.lit("-L"), line_end.cast("string")))


def pointer_lines(source: Column, ids: Column, text: Column, wing: Column, room: Column, place: Column, entities: Column) -> Column:
    """Topics, then quotes, as lines topic|entities|[place|]→ids; a text with neither has one line for its place in the store."""
    window = F.substring(text, 1, WINDOW)
    topics = F.concat(F.regexp_extract_all(window, F.lit(ACTION), 1), F.regexp_extract_all(window, F.lit(HEADER), 1))
    topics = F.slice(F.array_distinct(F.filter(F.transform(topics, lambda t: lowered(trimmed(t))), lambda t: t != "")), 1, MOST_TOPICS)
    quotes = F.transform(F.slice(F.regexp_extract_all(window, F.lit(QUOTE), 1), 1, MOST_QUOTES), lambda q: F.concat(F.lit('"'), q, F.lit('"')))
    heads = F.concat(topics, quotes)
    fallback = F.concat_ws("/", wing, room, F.substring(stem(source), 1, 40))
    heads = F.when(F.size(heads) > 0, heads).otherwise(F.array(fallback))
    tail = F.concat(F.lit("|"), F.array_join(entities, ";"), F.when(place == "", "").otherwise(F.concat(F.lit("|"), place)), F.lit("|→"), F.array_join(F.slice(ids, 1, MOST_IDS), ","))
    return F.transform(heads, lambda h: F.concat(h, tail))


def packed(lines: Column, limit: int = PACK_BYTES) -> Column:
    """Documents of whole lines, each as many as fit limit bytes (a line takes one more); a longer line stands alone."""
    begin = F.struct(F.array().cast("array<string>").alias("docs"), F.lit(0).alias("used"))

    def step(state: Column, line: Column) -> Column:
        size = F.octet_length(line) + 1
        fits = (state["used"] > 0) & (state["used"] + size <= limit)
        docs = state["docs"]
        longer = F.concat(F.slice(docs, 1, F.size(docs) - 1), F.array(F.concat(F.element_at(docs, -1), F.lit("\n"), line)))
        return F.when(fits, F.struct(longer.alias("docs"), (state["used"] + size).alias("used"))).otherwise(F.struct(F.concat(docs, F.array(line)).alias("docs"), size.alias("used")))

    return F.aggregate(lines, begin, step, lambda s: s["docs"])
