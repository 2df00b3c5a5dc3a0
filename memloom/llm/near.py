"""Near-duplicates by the similarity of whole texts, for filtering.

Two texts are near-duplicates where the Jaccard similarity of their sets of five-word shingles is
SIMILAR or more, and groups are what such links join. Candidates come in two passes, and all are
verified on the whole texts:

* `band_links`: in each band of the long SimHash every text meets the one that is crowded most, so there
  is at most one pair for each text and band, however large a group. The pivot distance table
  discards pairs by their maximum coordinate difference, then the Hamming limit does.
* `apart_links`: an equi-join on each text's first shingles, rarest first (a prefix filter for
  SIMILAR), gives what may still be similar but lies in different groups. Keys that only one group
  has are left out before the join, so copies don't multiply. No link is lost, but for
  collisions of 64-bit hashes; the first pass only saves work.

Defined cases: null texts have no words; texts without words are near-duplicates of equal texts only;
equal texts are one; rows with a null id have no group and all stay; rows that repeat id and
text come once; several texts of one id are tied; texts are read whole, however long; an empty table
gives an empty one; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import connected_components, stored
from memloom.llm.simhash import N_PIVOTS, SEED, majority_bits, pivot_table

#: Words in a shingle, and the Jaccard similarity of shingle sets from which texts are near-duplicates.
NEAR_SHINGLE, SIMILAR = 5, 0.8
#: The long fingerprint: 64-bit words, the least letters of words that it is made of, its bands, and the most differing bits of a candidate.
NEAR_WORDS, LEAST_LETTERS, BANDS, NEAR_LIMIT = 4, 5, 16, 40
#: 64-bit words of a text's parities.
PARITY_WORDS = 8
#: The sample that tells common shingles: documents at least, the least share of all, and the most shingles that are told.
SAMPLED, SAMPLED_SHARE, MOST_COMMON = 10_000, 0.01, 200_000
#: Words that are hashed at a time.
AT_ONCE = 1 << 19


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, for numbers whose bits must be spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted distinct hashes of the NEAR_SHINGLE-word shingles of each text, given by its words; of the whole text where it has fewer."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(words[i : i + AT_ONCE]) for words in [[w for t in texts for w in t]] for i in range(0, len(words), AT_ONCE))])
    starts = np.cumsum(counts) - counts

    def joined(at: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = mixed_bits(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + j])
        return h

    every = joined(np.arange(max(0, len(codes) - NEAR_SHINGLE + 1)), NEAR_SHINGLE)
    out = [np.unique(every[s : s + n - NEAR_SHINGLE + 1]) if n >= NEAR_SHINGLE else None for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
    for k in range(NEAR_SHINGLE):
        short = np.flatnonzero(counts == k)
        for i, h in zip(short.tolist(), joined(starts[short], k) if k else [()] * len(short), strict=True):
            out[i] = np.atleast_1d(np.array(h, np.uint64))
    return out


def shingle_set(text: bytes | None) -> set[int]:
    return set(shingle_sets([(text or b"").lower().split()])[0].tolist())


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """batch in slices of about most bytes of text, each with the words of its texts."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(lengths) // most
    for s, e in zip(*(np.flatnonzero(x) for x in (np.diff(piece, prepend=-1) != 0, np.diff(piece, append=np.inf) != 0)), strict=True) if len(piece) else ():
        part = batch.slice(s, e + 1 - s)
        yield part, [(t or b"").lower().split() for t in part.column(column).to_pylist()]


def long_fingerprints(texts: list[list[bytes]]) -> np.ndarray:
    """The SimHashes, by NEAR_WORDS seeds, of the distinct longer words of each text."""
    each = []
    for words in texts:
        words = set(words)
        each.append([w for w in words if len(w) >= LEAST_LETTERS] or list(words))
    counts = np.fromiter(map(len, each), np.int64, len(each))
    codes = word_hashes([w for x in each for w in x])
    return np.stack([majority_bits(mixed_bits(codes ^ np.uint64(mixed)), counts) for mixed in range(1, NEAR_WORDS + 1)], 1)


def digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def common_shingles(docs: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are frequent in a sample of docs (about n rows), sorted, and the rank of each: the most frequent is last.
    They only set the order of shingles, which any sample may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts)).view(np.int64))], ["h"])

    share = min(1.0, max(SAMPLED_SHARE, SAMPLED / max(1, n)))
    sample = docs.where(F.pmod(F.xxhash64(text_col, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * share)).select(F.col(text_col).cast("binary").alias("t"))
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    told = counts.orderBy(F.col("n").desc(), "h").limit(MOST_COMMON).orderBy("n", "h").select("h").toArrow()  # at most MOST_COMMON numbers
    hashes = told.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def first_shingles(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a text in one order for all texts: rare ones by their hashes, then common ones by rank.
    Two sets of similarity SIMILAR share one of as many first shingles as SIMILAR leaves out, and one."""
    size = len(own)
    if len(common) and size:
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        told = common[at] == own
        at = at[told]
        own = np.concatenate([own[~told], common[at[np.argsort(rank[at])]]])
    return own[: int(size * (1 - SIMILAR) + 1e-6) + 1]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """64 * PARITY_WORDS bits for each set: of each slot of the hashes, whether it holds an odd number of them. Two sets that differ
    in d shingles differ in d bits at most."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = 64 * PARITY_WORDS
    slot = (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(40)).astype(np.int64) % bits
    odd = np.bincount(np.repeat(np.arange(len(sets)), counts) * bits + slot, minlength=len(sets) * bits).reshape(-1, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def near_table(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, digest, fp, far, size, parity, firsts): the MD5 of the text, its long fingerprint and the row of the pivot distance
    table (both as bytes), the number of its shingles, their parities and the first ones."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, n))  # at most MOST_COMMON pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "t"):
                fps, sets = long_fingerprints(texts), shingle_sets(texts)
                odd = parities(sets)
                firsts = [first_shingles(s, common, rank) for s in sets]
                ends = np.cumsum([0, *map(len, firsts)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (fps, pivot_table(fps))), pa.array([len(s) for s in sets], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(odd.ravel())),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)))],
                    ["doc_id", "digest", "fp", "far", "size", "parity", "firsts"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, digest string, fp binary, far binary, size int, parity array<long>, firsts array<long>")


def rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of equally long bytes as a matrix of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def band_links(reps: DataFrame, n: int) -> DataFrame:
    """(a, b) of reps (rep, fp, far; about n rows): each text with the most crowded one of each of its bands, where the pair
    passes the pivot table and the Hamming limit. A band has as many bits as keep chance meetings to a few for each text."""
    bits = max(20, int(np.ceil(np.log2(max(2, n)))) - 2)
    rng = np.random.default_rng(SEED)
    picks = [rng.permutation(64 * NEAR_WORDS)[:bits] for _ in range(BANDS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                on = np.unpackbits(rows_of(part.column("fp"), np.uint8, 8 * NEAR_WORDS), axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([(on[:, p] << np.arange(bits)).sum(1) * BANDS + k for k, p in enumerate(picks)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(zero_copy_only=False), BANDS))], ["key", "rep"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.abs(rows_of(batch.column("fa"), np.int16, N_PIVOTS) - rows_of(batch.column("fb"), np.int16, N_PIVOTS)).max(1)
            i = np.flatnonzero(far <= NEAR_LIMIT)  # the maximum coordinate difference; survivors are verified
            x, y = (rows_of(batch.column(c).take(pa.array(i)), np.uint64, NEAR_WORDS) for c in ("pa", "pb"))
            i = i[np.bitwise_count(x ^ y).sum(1) <= NEAR_LIMIT]
            yield batch.select(["a", "b"]).take(pa.array(i))

    dealt = stored(reps.select("rep", "fp").mapInArrow(keyed, "key long, rep long"), "bands")
    crowds = dealt.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    met = stored(dealt.join(crowds, "key"), "met")
    hubs = met.join(met.groupBy("rep").agg(F.sum("crowd").alias("sum")), "rep").groupBy("key").agg(F.max(F.struct("sum", -F.col("rep"))).alias("most"))
    pairs = met.join(hubs.select("key", (-F.col("most.col2")).alias("hub")), "key").where("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("fp").alias(f"p{side}"), F.col("far").alias(f"f{side}")), side)
    return pairs.mapInArrow(near, "a long, b long").distinct()


def apart_links(known: DataFrame, grouped: DataFrame) -> DataFrame:
    """(a, b) of grouped (rep, group): all pairs of different groups that may have a similarity of SIMILAR or more, by the first
    shingles in known (doc_id, size, firsts).

    Most shingles are one text's own, so keys are counted first and only those that come again are dealt out with their rows;
    of these, keys that only one group has go next. Where a shingle is the first that two texts share, no more than what follows
    it in both is shared, so a key whose place is too late for both sizes is no candidate. Keys are asked of whole groups, so a pair of
    groups comes once however many keys and texts share them; then each text of the smaller group meets those of the larger one, by their sizes
    and parities: similar sets differ in a ninth of both their sizes at most. So a pair of texts comes once, and the join on hot
    groups is one that can be split."""
    every = known.select(F.col("doc_id").alias("rep"), "size", F.posexplode("firsts").alias("at", "key")).select("key", "rep", "size", (F.col("size") - F.col("at")).alias("rest"))
    again = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = stored(every.join(again, "key", "left_semi").join(grouped.select("rep", "group").distinct(), "rep"), "rows")
    several = rows.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key")
    rows = stored(rows.join(several, "key", "left_semi").distinct(), "rows")
    groups = rows.groupBy("key", "group").agg(F.min("size").alias("size"), F.max("rest").alias("rest"))
    may = (1 + SIMILAR) * F.least(F.col("x.rest"), F.col("y.rest")) >= SIMILAR * (F.col("x.size") + F.col("y.size")) - 1e-6
    met = groups.alias("x").join(groups.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.group") < F.col("y.group")) & may)
    met = met.groupBy(F.col("x.group").alias("g"), F.col("y.group").alias("h")).agg(F.count("*").alias("n")).drop("n")
    words = [f"p{k}" for k in range(PARITY_WORDS)]
    bits = known.select(F.col("doc_id").alias("rep"), "size", *(F.get("parity", F.lit(k)).alias(p) for k, p in enumerate(words))).distinct()
    members = stored(rows.select("rep", "size", "group").distinct().join(bits, ["rep", "size"]), "members")
    counts = members.groupBy("group").agg(F.count("*").alias("n"))
    met = met.join(counts.select(F.col("group").alias("g"), F.col("n").alias("ng")), "g").join(counts.select(F.col("group").alias("h"), F.col("n").alias("nh")), "h")
    swap = F.col("nh") < F.col("ng")
    sides = met.select(F.when(swap, F.col("h")).otherwise(F.col("g")).alias("group"), F.when(swap, F.col("g")).otherwise(F.col("h")).alias("other"))
    lefts = sides.join(members, "group").drop("group").withColumnRenamed("other", "group")
    apart = reduce(add, (F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in words))
    # of sizes x + y, sets of similarity s differ in (1 - s) / (1 + s) of them at most
    alike = (SIMILAR * F.greatest("x.size", "y.size") <= F.least("x.size", "y.size") + 1e-6) & ((1 + SIMILAR) * apart <= (1 - SIMILAR) * (F.col("x.size") + F.col("y.size")) + 1e-6)
    return lefts.alias("x").join(members.alias("y"), (F.col("x.group") == F.col("y.group")) & alike).select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) whose whole texts (rep, t) have a Jaccard similarity of SIMILAR or more."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in text_slices(batch, "ta"):
                right = [(t or b"").lower().split() for t in part.column("tb").to_pylist()]
                good = []
                for x, y in zip(shingle_sets(left), shingle_sets(right), strict=True):
                    met = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(met >= SIMILAR * (len(x) + len(y) - met) and met > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, group): equal texts, and texts that similarities of SIMILAR or more join, have one group, the
    least doc_id in it."""
    docs = docs.where(F.col(id_col).isNotNull())
    known = stored(near_table(docs, id_col, text_col, docs.count()), "near")
    reps = stored(known.groupBy("digest").agg(F.min(F.struct("doc_id", "fp", "far")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), "r.fp", "r.far"), "reps")
    # the texts of an id that comes with several are one node, so they are tied together
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), digest(text_col).alias("digest"), F.col(text_col).cast("binary").alias("t"))

    def links(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        marked = reps.select("rep", "digest").join(wanted, "rep", "left_semi")
        return similar_pairs(pairs, stored(texts.join(marked, ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]), "texts"))

    def rooted(roots: DataFrame) -> DataFrame:
        return reps.join(roots, reps.rep == roots.node, "left").withColumn("group", F.coalesce("root", "rep")).drop("node", "root")

    roots = connected_components(links(stored(band_links(reps, reps.count()), "pairs")))
    missed = stored(apart_links(known, rooted(roots)), "missed")
    if not missed.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links(missed)))
    return known.select("doc_id", "digest").distinct().join(rooted(roots).select("digest", "group"), "digest")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row with the least id stays, once; rows with a null id all stay."""
    kept = near_duplicate_groups(docs, id_col, text_col).groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("k")).select("k.*")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_id, own_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    own = plain.withColumn("digest", digest(own_text))
    stay = own.join(kept, (own[own_id].cast("long") == kept.doc_id) & (own.digest == kept.digest), "left_semi")
    repeated = plain.where(F.col(own_id).isNotNull()).groupBy(own_id).count().where("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([own_id, "digest"])
    return stay.drop("digest").union(plain.where(F.col(own_id).isNull())).toDF(*names)
