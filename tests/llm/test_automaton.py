"""The automaton against the tokenizers library, and small automata against merges that are applied one by one."""

import hashlib
import itertools
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import automaton
from memloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return automaton.AutomatonTokenizer(PATH)


def ids_of(ours, texts):
    flat, counts = ours.encode(texts)
    return [[flat.pop(0) for _ in range(n)] for flat in [flat.tolist()] for n in counts.tolist()]


def merged(word, merges):
    """A word by its merges, each applied to the whole word from the left."""
    parts = [*word[:-1], word[-1] + "</w>"]
    for u, v in merges:
        k = 0
        while k + 1 < len(parts):
            if (parts[k], parts[k + 1]) == (u, v):
                parts[k : k + 2] = [u + v]
            k += 1
    return parts


def test_small_automata_equal_their_merges(tmp_path):
    rng = random.Random(2)
    for trial in range(25):
        letters = "ab" if trial % 2 else "abc"
        tokens, merges = [*letters, *(x + "</w>" for x in letters)], []
        while len(merges) < 14:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if not u.endswith("</w>") and u + v not in tokens:
                merges.append([u, v])
                tokens.append(u + v)
        spec = {"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(spec))
        spec = automaton.read_spec(str(path))
        built = automaton.Automaton(spec, automaton.compile_arcs(spec))
        words = ["".join(w) for n in range(1, 9) for w in itertools.product(letters, repeat=n)]
        want = [merged(word, merges) for word in words]
        assert [[tokens[i] for i in built.word(word.encode())] for word in words] == want
        flat, counts = built.words([word.encode() for word in words])
        flat = iter(flat.tolist())
        assert [[tokens[next(flat)] for _ in range(n)] for n in counts.tolist()] == want


def test_equals_the_library_on_every_kind_of_character(ours, library):
    texts = [f"ab{c}cd {c} 1{c}2 '{c} A{c}{c}. {c}'s" for c in map(chr, [*range(0x2100), *range(0x3000, 0x3100), 0xAC00, 0xFB01, 0x1F600, 0x10FFFF])]
    texts += ["", " ", "Don't STOP they'Re 'S 42", "x" * 5000, "!" * 3000, "aA" * 20_000, "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|>é", "<|ENDOFTEXT|>", "<|endoftext|", "é é İI ΑΣ Σ", "\x00<|endoftext|>\x00", "İstanbul\x1c\x85²"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(ours, texts) == want
    labels = automaton.arc_labels(PATH)
    assert [" ".join(labels[i] for i in x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_random_words_and_a_bounded_cache(ours, library, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(automaton, "CACHE", 50)
    for _ in range(20):
        texts = ["".join(rng.choices(rng.choice(("aelost", "the quick'd ", "abéß ", "0159-_. ")), k=rng.randint(0, 300))) for _ in range(10)]
        assert ids_of(ours, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cases_of_tables(spark, library):
    rows = [(1, "One two", "x"), (1, "One two", "x"), (None, None, None), (2, "", "y"), (3, "word " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = automaton.encode_documents(docs, PATH, ids="found")
    assert out.columns == ["doc_id", "ids", "found"]
    got = automaton.decode_documents(out, PATH, ids="found").collect()
    want = [(i, x, library.encode(t or "", add_special_tokens=False).ids) for i, t, x in rows]
    assert [tuple(r) for r in got] == [(*w, library.decode(w[2], skip_special_tokens=False)) for w in want]
    assert automaton.decode_documents(automaton.encode_documents(docs.limit(0), PATH, ids="found"), PATH, ids="found").count() == 0
    assert automaton.decode_documents(spark.sql("select cast(null as array<int>) ids"), PATH).first().decoded == ""


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        automaton.read_spec(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_equals_the_library(spark, sf, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        ids = library.encode(r.t, add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in QUERIES["op13_bpe_automaton"](spark, sf).collect()} == want
