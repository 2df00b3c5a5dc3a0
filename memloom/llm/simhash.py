"""SimHash near-duplicates with pivot distance tables.

A pivot table holds, for each fingerprint, its Hamming distances to fixed reference
fingerprints. By the triangle inequality two fingerprints within distance d differ by at
most d in every coordinate, so pairs are discarded by their maximum coordinate difference
and only survivors are verified on the fingerprints themselves (and, in `near`, on the texts).

Defined cases: null texts have no words; a text without words has fingerprint zero and is
linked like any other; rows with equal texts share a fingerprint; rows with a null id keep
a null component; a half of the hashes is not over half; texts are read whole, however long; an
empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import connected_components, stored

SHINGLE, SEED, MAX_DISTANCE, N_PIVOTS = 3, 42, 2, 16
LANES = np.uint64(0x0001_0001_0001_0001)
MAX_LANE = 65_535


def shingle_hashes(text: bytes, k: int, seed: int) -> list[int]:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence where there are fewer words."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts hashes: a bit is 1 where over half of the run's hashes have it."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // MAX_LANE)  # a lane of 16 bits counts up to 65,535
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(n) - n
    cuts = first[owner] + MAX_LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    result = np.zeros(len(full), np.uint64)
    for shift in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, cuts)
        for lane in range(4):
            ones = np.bincount(owner, (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), len(full))
            result |= (ones * 2 > n).astype(np.uint64) << np.uint64(shift + 16 * lane)
    out[full] = result
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text; fp is the signed form of the unsigned value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingle_hashes(t or b"", k, seed) for t in batch.column(1).to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            hashes = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority_bits(hashes, counts).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = N_PIVOTS, words: int = 1) -> np.ndarray:
    """n fixed reference fingerprints of 64 * words bits."""
    return np.random.default_rng(SEED).integers(0, 2**64, (n, words), np.uint64, endpoint=False)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fps (rows of one or more 64-bit words) to the pivots, one row for each fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int16) for p in pivots(words=fps.shape[1])], 1)


def close_pairs(fps: np.ndarray, table: np.ndarray, run: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal run at Hamming distance of limit or less. Each run must be sorted by the table's first
    coordinate: what lies further apart there is not paired. The maximum coordinate difference discards further pairs, one
    coordinate at a time, and survivors are verified."""
    at = np.arange(len(fps))
    for gap in range(1, len(fps)):
        at = at[at + gap < len(fps)]
        at = at[(run[at + gap] == run[at]) & (table[at + gap, 0] - table[at, 0] <= limit)]  # sorted, so none comes back at a larger gap
        if not len(at):
            break
        i = at
        for p in range(1, table.shape[1]):
            i = i[np.abs(table[i, p] - table[i + gap, p]) <= limit]
        i = i[np.bitwise_count(fps[i] ^ fps[i + gap]) <= limit]
        yield i, i + gap


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by key, in pieces that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = np.flatnonzero(keys.to_numpy(zero_copy_only=False) != keys[-1].as_py())
        at = int(last[-1]) + 1 if len(last) else 0
        if at or (held and held[-1].column(key)[-1].as_py() != keys[0].as_py()):
            done = pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
            if done.num_rows:
                yield done
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def hamming_links(reps: DataFrame) -> DataFrame:
    """(a, b) links between rows of reps (rep, fp; fp distinct): all pairs at distance 2 or less.

    The pivot table is computed once for each fingerprint and goes with it. Two fingerprints at distance 2 or less
    agree on at least six of their eight bytes, so each row is dealt by its 28 choices of six bytes and no pair is
    lost. Rows of one bucket differ in the other two bytes only, so a bucket has 65,536 rows at most, of which each has
    136 partners at most: a task's memory and the number of links are bounded however alike the fingerprints are.
    """
    free = [(i, j) for i in range(8) for j in range(i)]
    kept = [(~((0xFF << 8 * i) | (0xFF << 8 * j)) + 2**63) % 2**64 - 2**63 for i, j in free]
    # the two free bytes are zero in the masked value; the hash takes the choice in
    key = F.explode(F.array(*[F.xxhash64(F.lit(c), F.col("fp").bitwiseAND(F.lit(m))) for c, m in enumerate(kept)]))

    def pivoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)[:, None]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("fp"), pa.array(table[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in table], pa.binary())], ["rep", "fp", "first", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "key"):
            keys, fps, reps = (rows.column(c).to_numpy() for c in ("key", "fp", "rep"))
            met = np.zeros(len(keys), bool)  # whose key another row has too
            met[1:] = keys[1:] == keys[:-1]
            met[:-1] |= met[1:]
            met = np.flatnonzero(met)
            if len(met):
                table = np.frombuffer(b"".join(rows.column("far").take(pa.array(met)).to_pylist()), np.uint8).reshape(len(met), -1).astype(np.int16)
                for a, b in close_pairs(fps[met].view(np.uint64), table, keys[met], MAX_DISTANCE):
                    a, b = reps[met[a]], reps[met[b]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    dealt = reps.select("rep", "fp").mapInArrow(pivoted, "rep long, fp long, first int, far binary").select("rep", "fp", "first", "far", key.alias("key"))
    return dealt.repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "a long, b long")


def components(fps: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of fps (doc_id, fp): component_id is the smallest doc_id that links of distance 2 or less reach."""
    known = fps.where("doc_id is not null")
    reps = known.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(hamming_links(reps))
    rooted = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(rooted, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): whole-text SimHash and the groups that links at distance 2 or less make."""
    return components(stored(fingerprints(docs, id_col, text_col), "simhash"))
