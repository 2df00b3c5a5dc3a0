"""Periodic runs against every stretch of every text, by definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from memloom.llm import runs
from memloom.llm.queries import QUERIES


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def by_definition(words):
    """(start, length, period): for each period the maximal stretches, if it is their smallest."""
    found, n = set(), len(words)
    for q in range(1, n // 3 + 1):
        s = 0
        while s < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if e > s and length >= max(24, 3 * q) and smallest_period(words[s : s + length]) == q:
                found.add((s, length, q))
            s = e + 1
    return sorted((s, n, q) for s, n, q in found)


def rewritten(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    table = str.maketrans("\t\n\x0b\x0c\r", "     ")
    words = rewritten(doc_id, [w for w in (text or "").translate(table).split(" ") if w])
    found = by_definition(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for j, w in enumerate(words) if j not in gone)))


def texts(rng):
    """Texts of few words, of repeated stretches, of neighbouring and overlapping runs, and of none."""
    for _ in range(120):
        kind, letters = rng.randrange(5), "abcdefgh"[: rng.randint(1, 8)]
        if kind == 0:
            yield rng.choices(letters, k=rng.randint(0, 150))
        elif kind == 1:
            unit = rng.choices(letters, k=rng.randint(1, 40))
            yield rng.choices(letters, k=rng.randint(0, 30)) + (unit * 9)[: rng.randint(20, 200)] + rng.choices(letters, k=rng.randint(0, 30))
        elif kind == 2:
            yield [w for _ in range(4) for w in (rng.choices(letters, k=rng.randint(1, 9)) * rng.randint(2, 12))]
        elif kind == 3:
            inner = rng.choices(letters, k=rng.randint(1, 4)) * rng.randint(5, 12) + rng.choices("xyz", k=2)
            yield inner * rng.randint(2, 5)
        else:
            yield [f"w{k}" for k in range(rng.randint(0, 200))]
    yield ["a"] * 23
    yield ["a"] * 24
    yield list("abcdefgh") * 3
    yield list("abcdefghi") * 3 + ["a"]
    yield list("aab") * 7 + ["a", "a"]


def test_equals_the_definition(spark, sf):
    rng = random.Random(3)
    rows = [(i, rng.choice((" ", "\n", "\t \r")).join(words), "clash") for i, words in enumerate(texts(rng))]
    rows += [(500, None, "x"), (501, "", "x"), (501, "", "x"), (502, "é " * 40, "x"), (503, "a a " * 30, "x"), (10_007, "b c " * 20, "x"), (10_007, "b c " * 20, "x")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and bool(t) for i, t, _ in rows) > 5
    folder_of = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.digests(runs.periodic_runs(folder_of, rewrite=True)).collect()
    want = [expected(i, t) for i, t, _ in rows]
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0]) or sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r[1] > 1 for r in want) > 20 and sum(r[1] == 0 for r in want) > 20
    assert runs.periodic_runs(folder_of.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "p q " * 30)], "doc_id long, text string")
    assert runs.digests(runs.periodic_runs(null_id, rewrite=True)).first()[1:5] == (1, 0, 60, 2)


def test_query_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 9000")
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_small_slices_and_false_hashes(monkeypatch):
    rng = random.Random(8)
    bodies = list(texts(rng))[:60]
    flat = np.array([hash(w) % 1000 if len(w) > 1 else ord(w) for b in bodies for w in b], np.int64)
    counts = np.array([len(b) for b in bodies], np.int64)

    def found():
        return [tuple(map(int, r)) for r in zip(*runs.find_runs(flat, counts), strict=True)]

    want = found()
    monkeypatch.setattr(runs, "PAIRS", 37)
    assert found() == want and len(want) > 30
    # hashes that call many unequal stretches equal: what they find is cut to what the words say
    monkeypatch.setattr(runs, "BASE", 1)
    plain = runs.Hashes.equal
    monkeypatch.setattr(runs.Hashes, "equal", lambda self, i, p, n: plain(self, i, p, n) | (n > 40))
    assert found() == want


def test_a_very_long_text_in_bounded_steps():
    words = np.concatenate([np.arange(50_000), np.tile(np.arange(7), 60_000), np.arange(50_000, 60_000), np.zeros(100_000, np.int64)])
    _, start, length, period = runs.find_runs(words, np.array([len(words)]))
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(50_000, 420_000, 7), (480_000, 100_000, 1)]
