"""Periodic runs of words: stretches that repeat themselves, found whole in every text.

A run is a stretch of consecutive words whose smallest period q has words q apart identical, of LEAST_RUN words and
LEAST_TURNS * q words at least, that no neighbouring word extends. They are found on a harmonic grid: for every period p,
grid points lie max(p, LEAST_STEP) words apart, so that a run of period p holds one whole step behind a grid point. All pairs
(period, grid point) of a slice of texts go at once through binary searches for the longest common extensions of the
point and the point one period later, to the right and to the left, on prefix hashes; pairs whose first word or first step
already differs leave at once. What is found is verified on the words, and runs found from several points or by
multiples of their period are one.

Words are numbered for each slice, so words are compared exactly. Hashes only save work: equal stretches always have
equal hashes, and a stretch that fails the verification is cut into what the words say.

Defined cases: a null text has no words; rows with a null id are read as they are (nothing is rewritten in
them); rows that repeat give rows that repeat; texts are read whole, a slice being one text where that is longer than
AT_ONCE words; of runs of the same exponent the one of smallest start, then period, is the greatest; an empty table
gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least words of a run, and the least turns of its period.
LEAST_RUN, LEAST_TURNS = 24, 3
#: The least distance of grid points: a run of a shorter period p has LEAST_RUN - p words in which the word one period later is equal, twice this.
LEAST_STEP = 8
#: Words of texts that are read at once, and pairs of period and grid point.
AT_ONCE, PAIRS = 1 << 18, 1 << 20
#: An odd number whose powers the prefix hashes take.
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    """BASE to the 0 .. n, modulo 2 ** 64."""
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Prefix hashes of a sequence of word numbers: whether stretches at i and at i + p are equal, for many at once."""

    def __init__(self, words: np.ndarray):
        spread = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        spread = (spread ^ (spread >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.power = powers(len(words))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((spread ^ (spread >> np.uint64(32))) * self.power[:-1], dtype=np.uint64)])

    def equal(self, i: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        own, later = self.prefix[i + n] - self.prefix[i], self.prefix[i + p + n] - self.prefix[i + p]
        return own * self.power[p] == later


def longest(equal: object, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest n of low .. high for which equal(rows, n) holds, of all rows at once; it holds for low."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_] + 1) // 2
        yes = equal(open_, mid)
        low[open_[yes]] = mid[yes]
        high[open_[~yes]] = mid[~yes] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def grid(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (text, period, grid point) of texts of that many words that begin at these places, some PAIRS at a time."""
    periods = np.where(counts >= LEAST_RUN, counts // LEAST_TURNS, 0)
    ends = np.cumsum(periods)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        rows = np.arange(first, min(first + PAIRS, int(ends[-1])))
        text = np.searchsorted(ends, rows, "right")
        period = rows - (ends - periods)[text] + 1
        step = np.maximum(period, LEAST_STEP)
        points = np.maximum((counts[text] - period) // step, 0)
        piece = (np.cumsum(points) - 1) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(rows)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            n = points[s:e]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(text[s:e], n), np.repeat(period[s:e], n), np.repeat(starts[text[s:e]], n) + place * np.repeat(step[s:e], n)


def verified(words: np.ndarray, start: int, end: int, p: int, first: int, last: int) -> list[tuple[int, int]]:
    """The stretches of period p that start .. end is made of, by its words: itself, or where hashes have lied what lies between the
    words that differ from those one period later, each as far as it goes in first .. last."""
    bad = (np.flatnonzero(words[start : end - p] != words[start + p : end]) + start).tolist()
    if not bad:
        return [(start, end)]
    out = []
    for s, e in zip([start, *(b + 1 for b in bad)], [*bad, end - p], strict=True):
        while s > first and words[s - 1] == words[s - 1 + p]:
            s -= 1
        while e + p < last and words[e] == words[e + p]:
            e += 1
        out.append((s, e + p))
    return out


def find_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of the texts that lie one after another in words, by text, start and period."""
    ends = np.cumsum(counts)
    starts = ends - counts
    hashes, found = Hashes(words), [np.zeros((0, 3), np.int64)]
    for text, p, i in grid(starts, counts):
        may = words[i] == words[i + p]  # the first probes of the search: one word, then a step
        text, p, i = text[may], p[may], i[may]
        may = hashes.equal(i, p, np.maximum(p, LEAST_STEP))
        text, p, i = text[may], p[may], i[may]
        right = longest(lambda at, n: hashes.equal(i[at], p[at], n), np.maximum(p, LEAST_STEP), ends[text] - p - i)
        left = longest(lambda at, n: hashes.equal(i[at] - n, p[at], n), np.zeros(len(i), np.int64), i - starts[text])
        start, end = i - left, i + right + p
        long = end - start >= np.maximum(LEAST_RUN, LEAST_TURNS * p)
        if long.any():
            found.append(np.unique(np.stack([start[long], end[long], p[long]], 1), axis=0))
    rows = np.concatenate(found)
    least: dict[tuple[int, int], int] = {}  # the smallest period of each run
    whole = None
    for start, end, p in np.unique(rows, axis=0).tolist():
        if whole == (start, end):  # verified with a smaller period
            continue
        k = int(np.searchsorted(ends, start, "right"))
        parts = verified(words, start, end, p, int(starts[k]), int(ends[k]))
        whole = parts[0] if len(parts) == 1 and parts[0] == (start, end) else None
        for s, e in parts:
            if e - s >= max(LEAST_RUN, LEAST_TURNS * p):
                least[s, e] = min(p, least.get((s, e), p))
    kept = np.array(sorted((s, p, e) for (s, e), p in least.items()), np.int64).reshape(-1, 3)
    text = np.searchsorted(ends, kept[:, 0], "right")
    return text, kept[:, 0] - starts[text], kept[:, 2] - kept[:, 0], kept[:, 1]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids, the places of words that a text of n words is made of, its end being a stretch that repeats; None: as it is."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
    """The ids and words of a batch's texts, of about AT_ONCE words at a time."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        words = (text or b"").split()  # at the bytes that end a word
        ids.append(doc_id)
        texts.append(words)
        held += len(words)
        if held >= AT_ONCE:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("best", pa.int32()), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: bool = False) -> DataFrame:
    """(doc_id, runs, best, collapsed): the runs (start, length, period) of each text by start and period, the place of the one of the
    greatest exponent in them (null: none), and the text's words without those in a run after its first period, joined by one
    space. With rewrite, texts of a tenth of the ids first get an end that repeats (`repeated_tail`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                if rewrite:
                    moved = [repeated_tail(i, len(words)) for i, words in zip(ids, texts, strict=True)]
                    texts = [words if at is None else [words[k] for k in at.tolist()] for at, words in zip(moved, texts, strict=True)]
                counts = np.fromiter(map(len, texts), np.int64, len(texts))
                flat = np.empty(int(counts.sum()), object)
                flat[:] = [w for words in texts for w in words]
                of, start, length, period = find_runs(pd.factorize(flat)[0], counts)
                cuts = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
                best, collapsed = [], []
                for k, words in enumerate(texts):
                    own = slice(cuts[k], cuts[k + 1])
                    runs = list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True))
                    best.append(max(range(len(runs)), key=lambda j: (Fraction(runs[j][1], runs[j][2]), -runs[j][0], -runs[j][2])) if runs else None)
                    if runs:
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, start[own] + period[own], 1)
                        np.add.at(gone, start[own] + length[own], -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words).decode(errors="replace"))
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows), pa.array(best, pa.int32()), pa.array(collapsed, pa.string())], schema=SCHEMA)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, best int, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """What `periodic_runs` found, in numbers and digests: the runs as lines of `start,length,period`, the greatest one, the text that is left."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get("runs", F.col("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * runs[best].length) div runs[best].period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
