"""Byte-pair encoding by a deterministic automaton, compiled from the merges of a public tokenizer file.

The automaton reads tokens. Its states are a start and one for each token that something may follow; an arc from a state
on a token exists where the merges would leave the two next to each other, so a path that spells a word is its encoding,
and each word has just one. It is compiled merge by merge. The gadget of the merge (u, v) to x

* makes the state of x, with the arcs that the state of v has by now (in the files read here every merge makes a token of its own);
* lets every state that has an arc on u have one on x, which leads there, but for the state of u where u is v, for
  equal tokens are merged from the left;
* takes the arc on v from the state of u.

The automaton is then made small: states with the same arcs are one, and so are tokens that the same states have arcs on. Arcs are
bits of a table of these states and kinds of tokens, which is bounded by the vocabulary. Words
are split as the file says, then encoded in one pass over their letters: from each place that is reached, tokens that begin
there are read from a table of prefixes, and those on which the state has an arc reach their ends. A place is reached in one way
only, as what lies before it has one encoding. Decoding emits the labels of the arcs, with a space between two.

Defined cases: null and empty texts have no ids, and decode to nothing; texts are read whole, however long; rows that
repeat or have a null id give rows of their own; the strings of special tokens in a text are these tokens, as the file says;
an empty table gives an empty one; further columns are kept by `encode_documents`, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm.common import held
from memloom.llm.tokens import Codes, byte_letters

#: What ends the last token of a word.
END = "</w>"
#: Distinct words that a worker keeps the ids of, their characters, and the characters of texts that are encoded at once.
CACHE, CACHE_CHARS, AT_ONCE = 200_000, 1 << 24, 1 << 19
#: Characters at most of words that go through the automaton together, and how many do.
LONG, WORDS = 60, 20_000
#: The split of a file whose texts need not go through the library: fixed values, as the file states them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The same for texts without ODD characters: those are in one normal form, and Python and the library class and lower them alike.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ODD = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]")


def read_spec(path: str) -> dict:
    """The file's content, if it is a BPE of words that end in END, each merge of which makes a token of its own."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path} isn't a BPE file of words that end in {END}")
    if len({u + v for u, v in model["merges"]}) < len(model["merges"]):
        raise ValueError("several merges make one token")
    return spec


@dataclass
class Arcs:
    """A compiled automaton: bit k of row s of the table says whether state s has an arc on tokens of kind k."""

    table: np.ndarray
    kind: np.ndarray  # of each token
    after: np.ndarray  # the state after each token that something may follow
    start: int

    def packed(self) -> tuple:
        return zlib.compress(self.table, 1), self.table.shape, self.kind, self.after, self.start

    @staticmethod
    def unpacked(packed: tuple) -> Arcs:
        return Arcs(np.frombuffer(zlib.decompress(packed[0]), np.uint8).reshape(packed[1]), *packed[2:])


def distinct_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table of bytes, and for each row which one it is."""
    whole = np.ascontiguousarray(table).view(np.dtype((np.void, table.shape[1]))).ravel()
    _, first, own = np.unique(whole, return_index=True, return_inverse=True)
    return table[first], own.astype(np.int32)


def turned(table: np.ndarray, columns: int) -> np.ndarray:
    """The table of bits with rows and columns exchanged, some columns at a time."""
    parts = [np.packbits(np.unpackbits(table[:, k : k + 64], axis=1, bitorder="little").T, axis=1, bitorder="little") for k in range(0, table.shape[1], 64)]
    return np.concatenate(parts)[:columns]


def compile_arcs(spec: dict) -> Arcs:
    """The automaton of a file, merge gadget by merge gadget on a table with a row for each token and a bit for each state, then made small."""
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    after = {vocab[t]: k for k, t in enumerate((t for t in vocab if not t.endswith(END)), 1)}  # 0 is the start; no state follows the end of a word
    made = {u + v for u, v in merges}
    base = [vocab[t] for t in vocab if t not in made]
    table = np.zeros((max(vocab.values()) + 1, len(after) // 8 + 1), np.uint8)
    every = np.zeros(table.shape[1], np.uint8)
    states = np.array([0, *(after[t] for t in base if t in after)])
    np.bitwise_or.at(every, states >> 3, np.left_shift(1, states & 7).astype(np.uint8))
    table[base] = every
    order = np.array([*base, *(vocab[u + v] for u, v in merges)])
    in_order = np.array_equal(order, np.arange(len(order)))  # tokens are numbered as they are made, so those that there are by now are a slice
    for k, (left, right) in enumerate(merges, len(base)):
        u, v, x = vocab[left], vocab[right], vocab[left + right]
        own = after.get(u)
        if own is None or not table[v, own >> 3] >> (own & 7) & 1:
            continue  # u and v never meet
        if (new := after.get(x)) is not None:
            old = after[v]
            rows = slice(0, k) if in_order else order[:k]
            table[rows, new >> 3] |= (table[rows, old >> 3] >> (old & 7) & 1) << (new & 7)
        table[x] = table[u]
        if u == v:
            table[x, own >> 3] &= 255 ^ (1 << (own & 7))
        table[v, own >> 3] &= 255 ^ (1 << (own & 7))
    kinds, kind = distinct_rows(table)
    small, state = distinct_rows(turned(kinds, len(after) + 1))
    follows = np.zeros(len(table), np.int32)
    for token, s in after.items():
        follows[token] = state[s]
    return Arcs(small, kind, follows, int(state[0]))


class Automaton:
    """The states and arcs of a tokenizer file, and the table by which tokens are found in the bytes of a word."""

    def __init__(self, spec: dict, arcs: Arcs):
        vocab = spec["model"]["vocab"]
        self.table, self.width, self.kind, self.after, self.start = arcs.table.reshape(-1), arcs.table.shape[1], arcs.kind, arcs.after, arcs.start
        of_letter = {c: b for b, c in byte_letters().items()}
        tokens = [(bytes(map(of_letter.__getitem__, t.removesuffix(END))), i, t.endswith(END)) for t, i in vocab.items()]
        prefixes = {t[:n] for t, _, _ in tokens for n in range(len(t))}  # what goes on comes first and has a row of its own
        node = {t: k for k, t in enumerate(sorted(prefixes))} | {t: k for k, t in enumerate(sorted({t for t, _, _ in tokens} - prefixes), len(prefixes))}
        self.going = len(prefixes)
        self.next = np.full((self.going, 256), -1, np.int32)
        for t, k in node.items():
            if t:
                self.next[node[t[:-1]], t[-1]] = k
        #: The token that the bytes up to a node are, inside a word and at its end.
        self.inner, self.last = np.full(len(node), -1, np.int32), np.full(len(node), -1, np.int32)
        for t, i, at_end in tokens:
            (self.last if at_end else self.inner)[node[t]] = i

    def word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        n, width, arcs, following = len(word), self.width, memoryview(self.table), memoryview(self.next.reshape(-1))
        inner, last, after, kind, going = memoryview(self.inner), memoryview(self.last), memoryview(self.after), memoryview(self.kind), self.going
        state, back = [self.start] + [-1] * n, [None] * (n + 1)
        for i in range(n):
            row, node = state[i] * width, 0
            for j in range(i, n):
                node = following[node * 256 + word[j]]
                if node < 0:
                    break
                t = inner[node] if j + 1 < n else last[node]
                if t >= 0 and arcs[row + (kind[t] >> 3)] >> (kind[t] & 7) & 1:
                    state[j + 1], back[j + 1] = after[t], (i, t)
                if node >= going:
                    break
        out, j = [], n
        while j:
            j, t = back[j]
            out.append(t)
        return out[::-1]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, which aren't empty, one after another, and the number of each; all words go through the tables at once,
        place by place, so this is for many words of few bytes."""
        size = np.fromiter(map(len, words), np.int32, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size, dtype=np.int32)
        first, end = np.repeat(ends - size, size), np.repeat(ends, size)
        # every token that lies anywhere in a word
        start, node, found = np.arange(len(text), dtype=np.int32), np.zeros(len(text), np.int32), []
        for k in range(int(size.max(initial=0))):
            node = self.next[node, text[start + k]]
            there = node >= 0
            start, node = start[there], node[there]
            done = end[start] == start + k + 1
            token = np.where(done, self.last[node], self.inner[node])
            good = np.flatnonzero(token >= 0)
            found.append((start[good], start[good] + np.int32(k + 1), token[good]))
            on = (node < self.going) & ~done
            start, node = start[on], node[on]
            if not len(start):
                break
        start, stop, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        # by where they end in their word, so that the state before each is known when its turn comes
        place = (stop - first[start]).astype(np.uint8)
        order = np.argsort(place, kind="stable")
        start, stop, token = start[order], stop[order], token[order]
        cuts = np.searchsorted(place[order], np.arange(1, int(size.max(initial=0)) + 2))
        state, back, label = np.full(len(text) + 1, self.start, np.int32), np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        for s, e in zip(cuts, cuts[1:], strict=False):
            kind = self.kind[token[s:e]]
            arc = np.flatnonzero(self.table[state[start[s:e]].astype(np.int64) * self.width + (kind >> 3)] >> (kind & 7) & 1) + s
            back[stop[arc] - 1], label[stop[arc] - 1] = start[arc], token[arc]
            arc = arc[stop[arc] < end[start[arc]]]
            state[stop[arc]] = self.after[token[arc]]
        # back from the ends
        counts, steps = np.zeros(len(words), np.int64), []
        which, at = np.arange(len(words)), ends - 1
        while len(which):
            steps.append((which, label[at]))
            counts[which] += 1
            at = back[at] - 1
            more = at >= (ends - size)[which]
            which, at = which[more], at[more]
        last = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        for k, (which, labels) in enumerate(steps):
            out[last[which] - 1 - k] = labels
        return out, counts


class AutomatonTokenizer:
    """Texts to ids. Distinct words go through the automaton once, as long as they are kept."""

    def __init__(self, path: str, arcs: Arcs | None = None):
        self.path, self.library, spec = path, None, read_spec(path)
        self.automaton = Automaton(spec, arcs or compile_arcs(spec))
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.plain = (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and splits == [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, byte_level]
        if not splits or splits[-1] != byte_level or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("texts of this file are split in another way")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.bytes = {ord(c): b for b, c in byte_letters().items()}
        self.clear()

    def clear(self) -> None:
        self.codes, self.chars, self.flat, self.ends = Codes(), 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, lower-cased and split as the file says."""
        if self.plain and not ODD.search(text):
            return PIECES.findall(text.lower())
        self.library = self.library or Tokenizer.from_file(self.path)
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(p.translate(self.bytes).encode("latin-1")).decode() for p, _ in split]

    def _keys(self, text: str) -> list[str]:
        """The words and special tokens of a text; a special token holds characters of several kinds, so it is no word."""
        if not any(s in text for s in self.special):
            return self.words(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [*self.words(text[at : found.start()]), "\x00" + found[0]]
            at = found.end()
        return out + self.words(text[at:])

    def _learn(self, keys: list[str]) -> None:
        """Adds the ids of keys, in their order."""
        many, alone = [], {}
        for k, key in enumerate(keys):
            if key[0] == "\x00" and key[1:] in self.special:
                alone[k] = [self.special[key[1:]]]
            elif len(key) > LONG:
                alone[k] = self.automaton.word(key.encode())
            else:
                many.append(key.encode())
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for s in range(0, len(many), WORDS):
            ids, n = self.automaton.words(many[s : s + WORDS])
            flat.append(ids)
            counts.append(n)
        flat, counts = np.concatenate(flat), np.concatenate(counts)
        if alone:
            parts = dict(zip((k for k in range(len(keys)) if k not in alone), np.split(flat, np.cumsum(counts)[:-1]), strict=False)) | {k: np.array(x, np.int32) for k, x in alone.items()}
            flat, counts = np.concatenate([parts[k] for k in range(len(keys))]), np.array([len(parts[k]) for k in range(len(keys))], np.int64)
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.chars += sum(map(len, keys))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each."""
        if len(self.codes) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        at, known = self.codes.__getitem__, len(self.codes)
        coded = [np.fromiter(map(at, keys), np.int32, len(keys)) for keys in map(self._keys, texts)]
        if len(self.codes) > known:
            fresh = reversed(self.codes)
            self._learn([next(fresh) for _ in range(len(self.codes) - known)][::-1])
        codes = np.concatenate([np.zeros(0, np.int32), *coded])
        size = np.diff(self.ends)[codes]
        last = np.cumsum(size)
        own = np.cumsum([0, *map(len, coded)])
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.ends[codes] - last + size, size)], np.diff(np.concatenate(([0], last))[own])


def arc_labels(path: str) -> dict[int, str]:
    """What the arcs on each token emit when ids are decoded."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["decoder"] is not None:
        raise ValueError(f"{path} has a decoder of its own")
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def tokenizer(path: str, packed: tuple) -> AutomatonTokenizer:
    """The tokenizer of a worker, which unpacks the automaton once."""
    return held(("automaton", path), lambda: AutomatonTokenizer(path, Arcs.unpacked(packed)))


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about most, as sizes has it for each row."""
    piece = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e > s:
            yield batch.slice(s, e - s)


def decode(ids: list[list[int]], label: dict[int, str]) -> pa.Array:
    return pa.array([" ".join(map(label.__getitem__, x)) for x in ids], pa.string())


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text in place of it, as the tokenizers library encodes it without adding special tokens, and where a
    name for it is given the text that these ids decode to. The automaton is compiled once, on the driver, and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(held(("arcs", path), lambda: compile_arcs(read_spec(path)).packed()))
    names = [c for c in docs.columns if c != text]
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    more = {"ids": F.lit(None).cast("array<int>")} | ({"decoded": F.lit("")} if decoded else {})
    schema, added = plain.drop("t").withColumns(more).schema, list(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = arc_labels(path) if decoded else None
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(0).buffers()[1], np.int32, batch.num_rows + 1 + batch.column(0).offset)[batch.column(0).offset :])
            for part in _slices(batch, sizes, AT_ONCE):
                found, counts = tokenizer(path, shared.value).encode(part.column(0).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], column, *([decode(column.to_pylist(), label)] if decoded else [])], [*part.schema.names[1:], *added])

    return plain.mapInArrow(run, schema).toDF(*names, ids, *([decoded] if decoded else []))


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the text that the ids of each row decode to, special tokens and all. Null ids decode to nothing."""
    names = encoded.columns
    plain = encoded.select(F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("i"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    schema = plain.drop("i").withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = None
        for batch in batches:
            label = label or arc_labels(path)
            for part in _slices(batch, batch.column(0).value_lengths().to_numpy(zero_copy_only=False), AT_ONCE // 4):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], decode(part.column(0).to_pylist(), label)], [*part.schema.names[1:], "decoded"])

    return plain.mapInArrow(run, schema).toDF(*names, decoded)
