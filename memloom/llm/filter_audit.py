"""How a row of document filters act on each other: an audit of every order in which they could be applied.

Words are exploded and aggregated by (document, word), then by document, for totals and distincts; outer-joined with the
flags of the other filters this gives each document the set of filters that it fails, and 32 conditional counts for each
part of the corpus (all documents, the good and the toxic ones) say everything about all 120 orders.

Filters: A, fewer than LEAST_WORDS words; B, fewer than half of the words distinct; C, over 3 % of the code points in
A-Z; D, any of `#$%&*|`; E, the text is also that of a smaller doc_id anywhere in the table.

Defined cases: a null text is an empty one; a null lang is the part of the empty string, with texts whose lang is empty;
rows with a null doc_id are documents of their own, neither smaller nor larger than others; rows that repeat count as
often as they come, and equal doc_ids aren't smaller than one another; labels that repeat count if any of them does, and
a null label is none; texts are read whole, however long; an empty table has no parts; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that filter A asks for, and the filters: bit k of a document's mask is set if it fails the k-th.
LEAST_WORDS, FILTERS = 200, "ABCDE"
MASKS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What is counted for each mask: the documents, and those among them that a label marks.
MEASURES = ("n", "good", "toxic")
#: What ends a word, and the capitals.
BREAKS, CAPITALS = r"[\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _keyed(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(doc_id, part, digest, mark, text). Rows of one doc_id have the same mark if they are equal."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("part"), F.unhex(F.md5(whole)).alias("digest"), whole.alias("text"))
    return named.select("doc_id", "part", "digest", F.xxhash64("part", "digest").alias("mark"), "text")


def word_counts(keyed: DataFrame) -> DataFrame:
    """(doc_id, mark, words, distinct_words) of each document with a word, by exploding its words. Rows that repeat become one
    first, which takes whole texts to the place by (doc_id, mark) where their words are aggregated without another shuffle."""
    words = keyed.groupBy("doc_id", "mark").agg(F.first("text").alias("text")).select("doc_id", "mark", F.explode(F.split("text", BREAKS)).alias("word")).where("word <> ''")
    by_word = words.groupBy("doc_id", "mark", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "mark").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, part, n, mask, good, toxic), one row for equal documents (n of them): the filters that they fail, and their labels."""
    keyed = _keyed(docs, doc_id, text, lang)
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    flags = keyed.groupBy("doc_id", "part", "digest", "mark", (100 * capitals > 3 * F.length("text")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d")).agg(F.count("*").alias("n"))
    # only texts that come with several ids can fail E
    least = flags.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = flags.join(least, "digest", "left").join(marked, F.col("doc_id") == F.col("labelled"), "left").alias("f")
    one = both.join(word_counts(keyed).alias("w"), F.col("f.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("f.mark") == F.col("w.mark")), "left_outer")
    total, distinct = F.coalesce(F.col("words"), F.lit(0)), F.coalesce(F.col("distinct_words"), F.lit(0))
    fails = (total < LEAST_WORDS, 100 * distinct < 50 * total, F.col("c"), F.col("d"), F.coalesce(F.col("f.doc_id") > F.col("least"), F.lit(False)))
    mask = sum((F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)) for k, fail in enumerate(fails)), F.lit(0))
    return one.select("f.doc_id", "f.part", "n", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def mask_counts(failed: DataFrame) -> DataFrame:
    """(part, n, good, toxic) of `failures`: for each part the 32 counts by mask, as arrays."""
    amount = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    columns = [F.sum(F.when(F.col("mask") == k, amount[m]).otherwise(0)).alias(f"{m}{k}") for m in MEASURES for k in MASKS]
    return failed.groupBy("part").agg(*columns).select("part", *(F.array(*(f"{m}{k}" for k in MASKS)).alias(m) for m in MEASURES))


def _total(measure: str, wanted: object, weight: object = None) -> Column:
    """The sum of a measure over the masks for which wanted(mask) holds."""
    each = F.transform(measure, lambda x, k: F.when(wanted(k), x if weight is None else x * weight(k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part, order and step."""
    counts = mask_counts(failures(docs, labels, doc_id, text, lang))
    orders = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.array(*(F.lit(1 << FILTERS.index(x)) for x in o)).alias("bits")) for o in ORDERS))
    steps = counts.select("*", F.explode(orders).alias("o")).select("part", *MEASURES, "o.filter_order", "o.bits", F.posexplode("o.bits").alias("at", "own"))
    steps = steps.withColumn("earlier", F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a + b))
    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda k: k.bitwiseAND(own) != 0
    gone = lambda k: k.bitwiseAND(earlier) != 0
    # a document is removed by each filter that it fails in as many of the 120 orders
    share = lambda k: F.lit(len(ORDERS)).cast("long") / F.bit_count(k)
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"),
        _total("n", lambda k: ~fails(k) & ~gone(k)).alias("kept"),
        _total("n", lambda k: fails(k) & ~gone(k)).alias("removed"),
        _total("n", lambda k: fails(k) & gone(k)).alias("redundant"),
        F.element_at("n", own + 1).alias("unique_fails"),
        _total("good", lambda k: fails(k) & ~gone(k)).alias("good_lost"),
        _total("toxic", lambda k: fails(k) & ~gone(k)).alias("toxic_lost"),
        _total("n", fails, lambda k: share(k).cast("long")).alias("shapley"),
    )
