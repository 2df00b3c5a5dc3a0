import random
from functools import lru_cache

import numpy as np
import pytest
import xxhash

from memloom.llm import near
from memloom.llm import simhash as sh

SCHEMA = "doc_id long, text string, fp string"


def naive(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [None, "", " \t", "one", "ONE", "two words"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for _ in range(60):
        words = rng.choice(texts[6:46]).split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "one", "no id")]
    got = sh.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = {i: naive(t) for i, t in enumerate(texts)}
    linked = [(i, j) for i in fps for j in fps if j < i and (fps[i] ^ fps[j]).bit_count() <= 2]
    want = roots(fps, linked)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fp % 2**64, r.component_id) == (fps[r.doc_id], want[r.doc_id])


def test_links_lose_nothing_in_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(20, k, replace=False)) for k in (0, 1, 2, 3, 4) for _ in range(80)})
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "rep long, fp long")
    found = roots(range(len(fps)), [(r.a, r.b) for r in sh.hamming_links(rows).collect()])
    want = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert found == want


def test_pivots_never_discard_a_close_pair():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, (50, 1)).astype(np.uint64)
    near = fps ^ np.uint64(0b101)
    gap = np.abs(sh.pivot_table(fps) - sh.pivot_table(near))
    assert gap.max() <= 2


@lru_cache(4096)
def shingles(text):
    return near.shingle_set(text.encode())


def jaccard(x, y):
    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b) if a | b else 0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(30)]
    for i in range(90):
        words = texts[i % 30].split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    hub = texts[0].split()
    for _ in range(150):  # over PAIRWISE in a bucket
        words = list(hub)
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", "short", "short"]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(7, texts[7], "repeated"), (None, "short", "a"), (None, None, "b")]
    kept = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= near.SIMILAR]
    want = roots(range(len(texts)), linked)
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 2


def kept_and_wanted(spark, texts):
    kept = near.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= near.SIMILAR]
    return sorted(r.doc_id for r in kept.collect()), sorted(set(roots(range(len(texts)), linked).values()))


def test_near_copies_meet_among_pages_of_one_fingerprint(spark):
    rng = random.Random(21)
    long_words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(40)]
    pages = []
    for _ in range(200):  # the same long words in another order, so all fingerprints are equal, and short fields
        order = rng.sample(long_words, len(long_words))
        pages.append([w for word in order for w in (word, str(rng.randrange(1000)))])
    texts = [" ".join(p) for p in pages]
    for k in range(0, 200, 5):
        copy = list(pages[k])
        copy[-1] = "zz"
        texts.append(" ".join(copy))
    got, want = kept_and_wanted(spark, texts)
    assert got == want and len(want) == 200


def test_short_near_copies_meet(spark):
    rng = random.Random(22)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    texts = []
    for i in range(300):  # few long words, so one that is appended moves many bits
        words = rng.sample(vocabulary, 1 + i % 6)
        words += [f"{rng.randrange(36**2):x}" for _ in range(8)]
        rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words, rng.choice(vocabulary)])]
    got, want = kept_and_wanted(spark, texts)
    assert got == want and len(want) < 400


@pytest.mark.parametrize("run", [sh.simhash_components, near.one_of_each])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long, 9, "a"), (2, long + " end", 9, "b"), (3, None, 9, "c"), (4, "", 9, "d"), (None, long, 9, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, digest string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in sh.simhash_components(docs).collect()}
    assert got[1][0] == naive(long) and got[3] == got[4] == (0, 3) and got[None][1] is None
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    # no words: null and empty are equal texts
    assert sorted((str(r.doc_id), r.digest) for r in kept.collect()) == [("1", "a"), ("3", "c"), ("None", "e")]


def test_pairs_within_six_bytes_are_bounded():
    """A bucket's rows agree in six bytes, so a row has 16 + 120 partners at most."""
    fps = np.arange(1 << 16, dtype=np.uint64)[:4096]
    table = sh.pivot_table(fps[:, None])
    order = np.argsort(table[:, 0], kind="stable")
    pairs = [(a, b) for x, y in sh.close_pairs(fps[order], table[order], np.zeros(len(fps), np.int64), 2) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    # of the 12 free bits here, 12 + 66 flips
    assert len(pairs) == len(set(pairs)) == 4096 * (12 + 66) // 2
