"""Token ids by a public byte-level BPE file, cached by stretches between single spaces.

Merges never cross pre-tokens, and a single space between other characters always begins one.
So the ids of a text are the ids of its stretches one after another, and each distinct stretch
goes through the tokenizers library once. Texts with added tokens, or with characters that
Python and the library class differently, go through the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from tokenizers import Tokenizer

from memloom.llm.common import held

#: The pre-tokens of a text without ODD characters.
PIECES = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = regex.compile(r"[\x01\x1c-\x1f\p{Nl}\p{No}]")
ODD_ASCII = re.compile(r"[\x01\x1c-\x1f]")
#: White space that is not one space or one line feed between other characters.
RUNS, WIDE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c"), re.compile(r"[^\S\x00-\x7f]")
#: Distinct stretches that a worker keeps.
CACHE = 1_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codes(dict):
    def __missing__(self, stretch: str) -> int:
        self[stretch] = code = len(self)
        return code


class PieceTokenizer:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_letters()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        """A key of codes is a stretch that follows a space, or \\x01 and one that doesn't, or a line feed."""
        self.codes, self.fresh, self.flat, self.ends = Codes(), 0, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, key: str) -> list[int]:
        text = key[1:] if key[0] == "\x01" else key if key == "\n" else " " + key
        return [t.id for p in PIECES.findall(text) for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]

    def _learn(self) -> None:
        known = len(self.ends) - 1
        if known < len(self.codes):
            keys = reversed(self.codes)
            ids = [self._ids(next(keys)) for _ in range(len(self.codes) - known)][::-1]
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])

    def _keys(self, text: str) -> list[str] | None:
        """None: the library has to read the text whole."""
        if (ODD_ASCII if text.isascii() else ODD).search(text) or any(a in text for a in self.added):
            return None
        if not text:
            return []
        if any(r in text for r in RUNS) or text[0] in " \n" or text[-1] in " \n" or (not text.isascii() and WIDE.search(text)):
            return [p[1:] if p[0] == " " and len(p) > 1 else "\n" if p == "\n" else "\x01" + p for p in PIECES.findall(text)]
        return ("\x01" + text.replace("\n", " \n \x01")).split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each."""
        if len(self.codes) > CACHE:
            self.clear()
        at, coded, whole = self.codes.__getitem__, [], {}
        for i, text in enumerate(texts):
            keys = self._keys(text)
            if keys is None:
                whole[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            coded.append(np.fromiter(map(at, keys or ()), np.int64, len(keys or ())))
        self._learn()
        codes = np.concatenate([np.zeros(0, np.int64), *coded])
        size = np.diff(self.ends)[codes]
        last = np.cumsum(size)
        own = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        counts = np.diff(np.concatenate(([0], last))[np.concatenate(([0], own))])
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(self.ends[codes] - last + size, size)]
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in whole.items():
                parts[i], counts[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, counts


def tokenizer(path: str) -> PieceTokenizer:
    return held(("tokenizer", path), lambda: PieceTokenizer(path))
