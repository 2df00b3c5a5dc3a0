import random

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions.entities import drawer_entities, frequencies, salient_entities
from memloom.functions.pointers import packed, pointer_lines
from memloom.functions.vectors import cosine


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(expr(*map(F.col, names))).first()[0]


def by_hand(content, size, overlap, least):
    t, out, start = content.strip(), [], 0
    while start < len(t):
        end = min(start + size, len(t))
        if end < len(t):
            for mark in ("\n\n", "\n"):
                at = t.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at
                    break
        piece = t[start:end].strip()
        if len(piece) >= least:
            out.append((len(out), piece, t[:start].count("\n") + 1, t[:end].count("\n") + 1))
        start = end - overlap if end < len(t) else end
    return out


@pytest.mark.parametrize("size,overlap,least", [(40, 8, 5), (50, 10, 3), (1600, 320, 50), (8, 2, 1)])
def test_boundary_chunks(spark, size, overlap, least):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab \n\n") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "x" * 3000]
    rows = tx.boundary_chunks(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", size, overlap, least).collect()
    for i, t in enumerate(texts):
        assert sorted((r.chunk_index, r.chunk, r.line_start, r.line_end) for r in rows if r.i == i) == by_hand(t, size, overlap, least)


def test_fixed_chunks_join_a_short_rest(spark):
    rows = tx.fixed_chunks(spark.createDataFrame([("abcdefghij k",)], "text string"), "text", 10, 0, 5).collect()
    assert [r.chunk for r in rows] == ["abcdefghij k"]


@pytest.mark.parametrize("source,text,want", [
    ("2024-11-08-notes.md", "x", "2024-11-08"), ("April-6th-2011-notes.txt", "", "2011-04-06"), ("s", "---\ndate: Nov 8 2024\n---\nbody", "2024-11-08"),
    ("s", "seen 31/12/2020 x", "2020-12-31"), ("s", "12/31/2020", "2020-12-31"), ("s", "8th November, 2023 and 2024-13-01", "2023-11-08"), ("s", "éJan 5 2020", "2020-01-05"), ("s", "Feb 30 2020", ""), ("", "none", ""),
])
def test_content_dates(spark, source, text, want):
    assert one(spark, tx.content_date, source, text) == want


@pytest.mark.parametrize("name,ok", [("a", True), ("a b.c-d'e", True), (" a ", True), ("a..b", False), ("a/b", False), ("", False), ("-a", False), ("é1", True), ("a" * 128, True), ("a" * 129, False)])
def test_names(spark, name, ok):
    assert one(spark, tx.valid_name, name) is ok


@pytest.mark.parametrize("value,want", [("", ""), ("2024-01-31", "2024-01-31"), ("2024-02-30", None), ("2024-01-01T10:00:00+00:00", "2024-01-01T10:00:00Z"), ("2024-01-01T10:00:00", None), (" ", None)])
def test_temporal(spark, value, want):
    assert one(spark, tx.temporal, value) == want


def test_tokens(spark):
    assert one(spark, tx.tokens, "A bc d_1 Éa x") == ["bc", "d_1", "éa"]


def test_entities(spark):
    rows = spark.createDataFrame([(1, "We use Claude Code and claude code with GPT-4o, GPT-4. Redis Redis The Redis Postgres"), (2, "plain Words Words Of Ab Ab")], "i int, t string")
    found = frequencies(rows, "i", "t")
    assert {r.i: r.entities for r in drawer_entities(found, "i").collect()} == {1: ["Claude Code", "Redis"], 2: ["Words"]}
    assert {r.i: r.entities for r in salient_entities(found, "i").collect()} == {1: ["Redis", "Claude Code"], 2: ["Ab", "Words"]}


def test_pointer_lines_and_packing(spark):
    text = '# The header line\nWe built the cache layer.\n"a quotation of some length"'
    lines = one(spark, lambda t: pointer_lines(F.lit("a/b.md"), F.array(*map(F.lit, "wxyz")), t, F.lit("w"), F.lit("r"), F.lit("2024-01-01:L1-L3"), F.array(F.lit("E"))), text)
    assert lines == ["built the cache layer|E|2024-01-01:L1-L3|→w,x,y", "the header line|E|2024-01-01:L1-L3|→w,x,y", '"a quotation of some length"|E|2024-01-01:L1-L3|→w,x,y']
    assert one(spark, lambda t: packed(F.split(t, ","), 6), "aa,bb,cccccccc,d") == ["aa\nbb", "cccccccc", "d"]


def test_cosine(spark):
    assert one(spark, cosine, [1.0, 0.0], [1.0, 0.0]) == 1.0
    assert one(spark, cosine, [1.0, 0.0], [0.0, 0.0]) == 0.0
    assert one(spark, cosine, [1.0], [1.0, 0.0]) == 0.0
