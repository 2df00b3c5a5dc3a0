"""Benchmark decontamination by a distributed positional inverted index.

A benchmark window's terms are counted in the training corpus; its anchors are its ANCHORS rarest
terms, each with the term next to it, so that a frequent term alone never is a key. The index has,
for every document, the postings (positions) of the pairs that are some window's anchors. A query
joins windows and postings by pair, shifts each posting by its anchor's offset and intersects the
lists of a window from the rarest on: where all meet, the phrase is compared word for word with the
document; where the first two meet within SLOP words, the window is a proximity match.

Terms, windows, counts and postings are tables that are joined by key: nothing of the benchmark's
size goes through the driver or to every task but a sieve of SIEVE_BITS bits, which only spares
rows (a key that isn't there finds no partner). All documents are read twice, whatever the size of
the benchmark.

Defined cases: null or empty texts have no words; items without words match nothing; items under
WINDOW words are one window; equal windows of several items report each; a null item id marks
words but isn't listed; rows that repeat a document id are judged each by its own text, and
repeated rows alike; ties of frequency go by the term; an empty benchmark leaves every document
clean; texts are read whole, however long; other columns are ignored, and kept by
`without_contaminated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import stored
from memloom.llm.near import mixed_bits

WINDOW, ANCHORS, SLOP = 13, 2, 8
#: Bits of the sieve, of which a key sets two, and bits of one of its blocks.
SIEVE_BITS, BLOCK_BITS = 1 << 25, 1 << 16
#: Bytes of text whose words are hashed at a time.
AT_ONCE = 1 << 22
#: A-Z as a-z, digits, a-z and all bytes of other characters as they are, any other byte as a space.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Stands for a null id where rows are joined; the hash of the text is part of every such key.
NO_ID = -(1 << 63)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def codes_of(words: list[bytes]) -> np.ndarray:
    return mixed_bits(pd.util.hash_array(np.array(words, dtype=object), categorize=False)) if words else np.zeros(0, np.uint64)


def pair_codes(codes: np.ndarray) -> np.ndarray:
    """The keys of neighbouring terms, one less than codes."""
    return mixed_bits(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])


class Sieve:
    """Bits that tell which keys may be in a table."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in (keys, keys >> np.uint64(32)):
            at = (at & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def sieve(keys: DataFrame) -> Sieve:
    """The sieve of keys (key), made block by block; SIEVE_BITS come to the driver at most."""

    def block(rows: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, np.uint8)
        bits[rows.column("bit").to_numpy()] = 1
        return pa.table({"block": rows.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = F.explode(F.array(F.col("key").bitwiseAND(F.lit(SIEVE_BITS - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(SIEVE_BITS - 1)))).alias("at")
    set_ = keys.select(at).select(F.floor(F.col("at") / BLOCK_BITS).cast("int").alias("block"), (F.col("at") % BLOCK_BITS).cast("int").alias("bit")).distinct()
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for row in set_.groupBy("block").applyInArrow(block, "block int, bits binary").toLocalIterator():
        out[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return Sieve(out)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """A batch with texts t in slices of about AT_ONCE bytes, each with its texts' words."""
    start, size, words = 0, 0, []
    for i, text in enumerate(batch.column("t").to_pylist()):
        words.append(words_of(text))
        size += len(text or b"")
        if size >= AT_ONCE:
            yield batch.slice(start, i + 1 - start), words
            start, size, words = i + 1, 0, []
    if words:
        yield batch.slice(start), words


def term_counts(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """(code, n): the occurrences in all texts (column t) of each term that the sieve lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # SIEVE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _pieces(batch):
                codes = codes_of([w for ws in words for w in ws])
                codes, n = np.unique(codes[shared.value.has(codes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], ["code", "n"])

    return docs.select("t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, wanted: Sieve, single: bool) -> DataFrame:
    """(d, mark, n_words, folded, keys, at) of docs (d, mark, t): the keys of the pairs of neighbouring terms, and with single of
    the terms alone, that the sieve lets through, with their positions; folded are the words of a document that has any."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # SIEVE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _pieces(batch):
                counts = np.fromiter(map(len, words), np.int64, len(words))
                starts = np.cumsum(counts) - counts
                codes = codes_of([w for ws in words for w in ws])
                keys = pair_codes(codes) if len(codes) else codes
                owner = np.repeat(np.arange(len(words)), counts)
                hit = np.flatnonzero(shared.value.has(keys))
                hit = hit[owner[hit] == owner[hit + 1]]  # not over the end of a text
                keys, at = keys[hit], hit
                if single:
                    alone = np.flatnonzero(shared.value.has(codes))
                    keys, at = np.concatenate([keys, codes[alone]]), np.concatenate([at, alone])
                    order = np.argsort(at, kind="stable")
                    keys, at = keys[order], at[order]
                own = np.bincount(owner[at], minlength=len(words))
                ends = pa.array(np.concatenate(([0], np.cumsum(own))).astype(np.int32))
                at = at - starts[owner[at]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), part.column("mark"), pa.array(counts), pa.array([b" ".join(w) if n else None for w, n in zip(words, own.tolist(), strict=True)], pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))],
                    ["d", "mark", "n_words", "folded", "keys", "at"],
                )

    return docs.select("d", "mark", "t").mapInArrow(run, "d long, mark long, n_words long, folded binary, keys array<long>, at array<int>")


def with_codes(rows: DataFrame, *terms: str) -> DataFrame:
    """rows (win, rank, offset, ..., terms) with key: the code of one term, or of a pair; a null second term is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(t).to_pylist() for t in terms]
            codes = [codes_of([(w or "").encode() for w in side]) for side in sides]
            keys = codes[0]
            if len(terms) == 2 and len(keys):
                pairs = mixed_bits(codes[0] * np.uint64(0x9E3779B97F4A7C15) + codes[1])
                keys = np.where([w is None for w in sides[1]], codes[0], pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "key"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", key long")


def windows_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, win, phrase): each window of each item; win is a hash of the phrase."""
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.regexp_extract_all(folded, F.lit(WORDS), 1).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    cut = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda s: F.array_join(F.slice("w", s, size), " "))).alias("phrase")).distinct()
    return cut.select("item_id", F.xxhash64("phrase").alias("win"), "phrase")


def anchors_of(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, size, rank, of, offset, key) for phrases (win, phrase): the ANCHORS rarest distinct terms of each by counts (code, n),
    each at its first place, as pairs with the next term, the last with the one before; of: how many pairs a window has."""
    terms = phrases.select("win", F.split("phrase", " ").alias("w")).select("win", "w", F.explode(F.array_distinct("w")).alias("term"))
    rare = with_codes(terms.select("term").distinct(), "term").join(counts.withColumnRenamed("code", "key"), "key", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy("win").orderBy("n", "term")  # a window's terms, WINDOW at most
    best = terms.join(rare, "term").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < ANCHORS)
    size = F.size("w")
    offset = F.least(F.array_position("w", F.col("term")).cast("int") - 1, F.greatest(size - 2, F.lit(0)))
    placed = best.select("win", size.alias("size"), offset.alias("offset"), "rank", F.element_at("w", offset + 1).alias("first"), F.get("w", offset + 1).alias("second"))
    placed = placed.groupBy("win", "size", "offset", "first", "second").agg(F.min("rank").alias("rank"))  # both terms may be one pair
    return with_codes(placed.withColumn("of", F.count("*").over(Window.partitionBy("win")).cast("int")), "first", "second").drop("first", "second")


def shifted_lists(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(d, mark, win, size, rank, of, start): each posting of an anchor, shifted by its offset to where the window would start."""
    posting = index.select("d", "mark", "n_words", F.explode(F.arrays_zip("keys", "at")).alias("p")).select("d", "mark", "n_words", F.col("p.keys").alias("key"), F.col("p.at").alias("pos"))
    met = posting.join(anchors, "key").withColumn("start", F.col("pos") - F.col("offset"))
    return met.where("start >= 0 and start + size <= n_words").select("d", "mark", "win", "size", "rank", "of", "start")


def phrase_candidates(shifted: DataFrame) -> DataFrame:
    """(d, mark, win, start): where the lists of all anchors of a window meet."""
    met = shifted.groupBy("d", "mark", "win", "start", "of").agg(F.count_distinct("rank").alias("n"))
    return met.where("n = of").select("d", "mark", "win", "start")


def proximity_matches(shifted: DataFrame, slop: int = SLOP) -> DataFrame:
    """(d, mark, win, start): where a posting of a window's rarest pair has one of its second within slop words of the place
    that the window gives it. Starts are dealt to cells of slop + 1 words and the second list also to the next cells, so this
    is an equi-join."""
    cell = F.floor(F.col("start") / (slop + 1))
    key = ["d", "mark", "win"]
    two = shifted.where("of > 1").withColumn("first", F.col("rank") == 0)
    first = two.where("first").select(*key, "start", cell.alias("cell")).distinct()
    second = two.where("not first").select(*key, F.col("start").alias("other"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    return first.join(second, [*key, "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slop).select(*key, "start").distinct()


def confirmed(candidates: DataFrame, index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(d, mark, n_hit, wins): the words of each document inside windows that it has word for word, and those windows."""
    spots = candidates.join(phrases, "win").groupBy("d", "mark").agg(F.collect_list(F.struct("start", "win", "phrase")).alias("spots"))  # a document's own
    texts = index.where("folded is not null").select("d", "mark", "folded").dropDuplicates(["d", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, found = [], []
            for folded, spots in zip(batch.column("folded").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                words, hit, wins = folded.split(b" "), bytearray(), set()
                hit = bytearray(len(words))
                for s in spots:
                    phrase = s["phrase"].encode().split(b" ")
                    if words[s["start"] : s["start"] + len(phrase)] == phrase:
                        hit[s["start"] : s["start"] + len(phrase)] = b"\1" * len(phrase)
                        wins.add(s["win"])
                hits.append(sum(hit))
                found.append(sorted(wins))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("mark"), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["d", "mark", "n_hit", "wins"])

    return spots.join(texts, ["d", "mark"]).select("d", "mark", "folded", "spots").mapInArrow(run, "d long, mark long, n_hit long, wins array<long>").where("n_hit > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int = SLOP) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, items, n_near): for every row of docs a hash of its text, its words, those inside benchmark
    windows, the sorted item ids (strings), and its proximity matches, exact ones included."""
    doc_id, mark = F.col(id_col).cast("long"), F.xxhash64(text_col)
    texts = docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("d"), mark.alias("mark"), F.col(text_col).cast("binary").alias("t"))
    windows = stored(windows_of(benchmark, item_id, item_text), "windows")
    phrases = windows.select("win", "phrase").distinct()
    terms = with_codes(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "term")
    anchors = stored(anchors_of(phrases, term_counts(texts, sieve(terms))), "anchors")
    index = stored(build_index(texts, sieve(anchors), not anchors.where("size = 1").isEmpty()), "postings")
    shifted = stored(shifted_lists(index, anchors), "shifted")
    exact = stored(confirmed(phrase_candidates(shifted), index, phrases), "exact")
    near = proximity_matches(shifted, slop).groupBy("d", "mark").agg(F.count("*").alias("n_near"))
    owners = windows.where("item_id is not null").select("win", "item_id")
    items = exact.select("d", "mark", F.explode("wins").alias("win")).join(owners, "win").groupBy("d", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = index.select("d", "mark", "n_words").join(exact.drop("wins"), ["d", "mark"], "left").join(items, ["d", "mark"], "left").join(near, ["d", "mark"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "mark", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", zero).alias("n_near"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """Whether a twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, and others) that aren't contaminated."""
    out = contamination(docs, benchmark).where(contaminated()).select("doc_id", "mark").distinct()
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    return plain.join(out, own_id.cast("long").eqNullSafe(out.doc_id) & (F.xxhash64(text) == out.mark), "left_anti").toDF(*names)
