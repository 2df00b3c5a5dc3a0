import base64
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import pfor
from memloom.llm.token_ledger import Ledger, count_tokens
from memloom.llm.tokens import PieceTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER, PIECES = Tokenizer.from_file(PATH), PieceTokenizer(PATH)
ALPHABET = "abC éß中1²_.,'\n\t \u3000\x1c<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET) | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_pieces_are_the_tokenizer(texts):
    ids, counts = PIECES.encode(texts)
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 900), max_size=700))
def test_blocks_round_trip(values):
    data = io.BytesIO(pfor.encode_segment(np.array([5]), np.array([len(values)]), np.array(values, np.uint32)) * 2)
    for _ in range(2):
        doc_ids, counts, ids = pfor.decode_segment(data.read)
        assert (doc_ids.tolist(), counts.tolist(), ids.tolist()) == ([5], [len(values)], values)
    assert pfor.decode_segment(data.read) is None


def test_token_files(spark):
    texts = ["a b", None, "", "<|endoftext|> x", "long " * 30_000, "a b"]
    rows = [(9 - i, t, i) for i, t in enumerate(texts)] + [(4, "again", 1), (None, "no id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = pfor.read_token_files(pfor.write_token_files(docs, PATH, 2)).collect()
    at, want = 0, []
    by_id = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0] for r in by_id]
    lengths = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        lengths.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    for key, text, _ in rows:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((len(ids), zlib.crc32(ids.tobytes())) in lengths[key])
    assert all(want)


def test_no_files_for_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pfor.read_token_files(pfor.write_token_files(docs, PATH, 2)).count() == 0


EVENT = "op string, source string, lang string, tokenizer string, tokens long, old_tokenizer string, old_tokens long"


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "t1", 5, None, None), ("insert", "a", "en", "t1", 7, None, None), ("insert", None, None, "t1", 0, None, None)], EVENT)
    second = spark.createDataFrame([("revise", "a", "en", "t2", 4, "t1", 5), ("delete", "a", "en", "t1", 7, None, None)], EVENT)
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    assert ledger.commit("b2", second) and not ledger.commit("b2", first)
    assert ledger.commit("b3", spark.createDataFrame([], EVENT))
    assert {tuple(r) for r in ledger.totals().collect()} == {("a", "en", "t2", 1, 4), (None, None, "t1", 1, 0)}
    with pytest.raises(Exception, match="unknown op"):
        ledger.commit("b4", spark.createDataFrame([("move", "a", "en", "t1", 1, None, None)], EVENT))


def test_ledger_overwrites_a_batch_without_commit(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.createDataFrame([("insert", "a", "en", "t1", 5, None, None)], EVENT)
    ledger.commit("b1", rows)
    spark.createDataFrame([("a", "en", "t1", 9, 9, "b2")], "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch_id string").write.parquet(f"file://{tmp_path}/ledger/deltas/b2")
    assert ledger.totals().first().n_tokens == 5
    ledger.commit("b2", rows)
    assert ledger.totals().first().n_tokens == 10


def test_counts(spark):
    docs = spark.createDataFrame([(1, "one two", "s", "en", 1), (2, None, None, None, 2), (3, "trois mots", "s", "fr", 3)], "doc_id long, text string, source string, lang string, tokens int")
    got = {r.doc_id: (r.tokens, r.other_tokens) for r in count_tokens(docs, PATH, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "lang = 'fr'").collect()}
    assert got[1] == (2, None) and got[2] == (0, None) and got[3][0] == len(TOKENIZER.encode("trois mots", add_special_tokens=False).ids) and got[3][1] > 0


def test_the_rollup_query_matches_a_recount(spark, sf):
    from memloom.llm.queries import op6_token_rollup

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    low = set(labels[labels.quality == 0].doc_id)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    other = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in docs.itertuples():
        if r.doc_id not in low:
            english = r.lang == "en"
            n = len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) if english else len(other.encode_ordinary(r.text or ""))
            key = (r.source, r.lang, "byte_bpe_50k" if english else "byte_bpe_multi_50k")
            a, b = want.get(key, (0, 0))
            want[key] = a + 1, b + n
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op6_token_rollup(spark, sf).collect()} == want


def test_maintained_totals_are_the_recount_and_old_versions_go(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    for k in range(4):
        rows = [("insert", "a", "en", "t1", 5 + k, None, None), ("insert", "b", None, "t1", 1, None, None), ("insert", "b", None, "t1", 1, None, None), ("delete", "c", "en", "t1", 2, None, None)]
        ledger.commit(f"b{k}", spark.createDataFrame(rows, EVENT).withColumn("n_docs", F.lit("clash")))
    assert {tuple(r) for r in ledger.totals().collect()} == {tuple(r) for r in ledger.recounted().collect()} == {("a", "en", "t1", 4, 26), ("b", None, "t1", 8, 8), ("c", "en", "t1", -4, -8)}
    ledger.prune()
    assert sorted(p.name for p in (tmp_path / "ledger" / "totals").iterdir() if p.is_dir()) == ["3", "4"] and ledger.totals().count() == 3
