"""Secret scans with a recursive decoding worklist.

Each text is scanned by the base patterns. Then stretches that are percent-encoded, escaped
(\\uXXXX, \\UXXXXXXXX, \\xXX), base64 or compressed inside base64 are unwrapped into layers, each
layer is scanned and unwrapped in turn, and what is found is mapped back to the code points of the
outer text that it came from. A layer that was seen before at the same place is not entered again,
so the worklist ends for inputs that decode to themselves too.

What a compressed stream holds stands for all of its run from the stream's start, so of it only the kinds that occur matter. Such
layers are bytes, in a temporary file of the task once they are over IN_MEMORY, which expressions search as a whole: no run, line or
match is cut at a border, however long, and memory doesn't grow with what a stream inflates to. They are unwrapped one by one, the
deepest first, percent signs and escapes over the whole layer.

Defined cases: null is the empty text, with no spans; equal spans are kept once; base spans always
stay; bytes that aren't UTF-8 are replacement characters; texts and layers are read whole, however long; rows that repeat or have a
null id give rows of their own; an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is matched whole, so a run of 24 or more is the base pattern's match.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MARKS = ("passw", "secret", "token", "api")
PERCENT = re.compile("%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
#: A run of the letters of both alphabets, with what follows on the next lines.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
STRETCH = re.compile(r"\S+")
BAD = re.compile("[\udc80-\udcff]")
#: Starts of gzip, zlib, bzip2 and xz streams.
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: The same expressions for layers of bytes.
ASSIGN_B, ACCESS_B, HEX_B = re.compile(ASSIGN.pattern.encode(), re.IGNORECASE), re.compile(ACCESS.pattern.encode()), re.compile(rb"[0-9a-f]{24}")
PERCENT_B, ESCAPE_B, BASE64_B = (re.compile(p.pattern.encode()) for p in (PERCENT, ESCAPE, BASE64))
#: Bytes of a layer that are held in memory, and that are read or inflated at a time.
IN_MEMORY, PIECE = 1 << 24, 1 << 20
#: Base64 of the second alphabet as the first, and what may stand between its lines.
FIRST_ALPHABET, BETWEEN = bytes.maketrans(b"-_", b"+/"), b" \t\r\n"

Layer = tuple[str, np.ndarray, np.ndarray]
Stream = tuple[bytes | mmap.mmap, int, int]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    found = []
    if any(m in (low := text.lower()) for m in ASSIGN_MARKS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _from_pieces(pieces: list[tuple[str, int, int]], data: bool) -> Layer:
    """A layer from (characters, start, end) pieces; data: the characters are bytes of UTF-8 in part."""
    text = "".join(p[0] for p in pieces)
    sizes = [len(p[0]) for p in pieces]
    starts, ends = (np.repeat(np.array([p[k] for p in pieces], np.int32), sizes) for k in (1, 2))
    return (text, starts, ends) if not data else _utf8(text.encode("latin-1"), starts, ends)


def _utf8(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Layer:
    """The text of bytes, each of which stands for [start, end) outside; a byte that isn't UTF-8 is a replacement character."""
    text = data.decode(errors="surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    one = (codes < 0x80) | ((codes >= 0xDC80) & (codes <= 0xDCFF))
    lead = np.cumsum(np.where(one, 1, 2 + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000)))
    return BAD.sub("\ufffd", text), starts[np.concatenate(([0], lead[:-1]))[: len(lead)]], ends[lead - 1]


def percent_layer(text: str) -> Layer:
    """Percent signs decoded as UTF-8 bytes; other characters stay."""
    pieces, at = [], 0
    while at < len(text):
        if text[at] == "%" and re.match("[0-9A-Fa-f]{2}", text[at + 1 : at + 3]):
            pieces.append((chr(int(text[at + 1 : at + 3], 16)), at, at + 3))
            at += 3
        else:
            pieces += [(chr(b), at, at + 1) for b in text[at].encode(errors="replace")]
            at += 1
    return _from_pieces(pieces, data=True)


def escape_layer(text: str) -> Layer:
    pieces, at = [], 0
    for m in ESCAPE.finditer(text):
        code = int(m[1] or m[2] or m[3], 16)
        pieces += [(c, at + i, at + i + 1) for i, c in enumerate(text[at : m.start()])]
        pieces.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", m.start(), m.end()))
        at = m.end()
    pieces += [(c, at + i, at + i + 1) for i, c in enumerate(text[at:])]
    return _from_pieces(pieces, data=False)


def pieces_of(data: bytes | memoryview | mmap.mmap) -> Iterator[bytes]:
    for s in range(0, len(data), PIECE):
        yield bytes(data[s : s + PIECE])


def inflate(data: bytes | memoryview | mmap.mmap) -> Iterator[bytes]:
    """What the gzip, zlib, bzip2 or xz streams at the start of data hold, member after member, up to where they break."""
    chunks = pieces_of(data)
    left = next(chunks, b"")
    while STREAM.match(left):
        zipped = left[:1] in (b"\x1f", b"\x78")
        stream = zlib.decompressobj(47) if zipped else bz2.BZ2Decompressor() if left[:1] == b"B" else lzma.LZMADecompressor()
        try:
            while not stream.eof:
                if left or (not zipped and not stream.needs_input):
                    out = stream.decompress(left, PIECE)
                    left = stream.unconsumed_tail if zipped else b""
                    if out:
                        yield out
                elif (left := next(chunks, b"")) == b"":
                    return
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            return
        left = stream.unused_data
        while len(left) < 6 and (more := next(chunks, b"")):
            left += more


def gathered(pieces: Iterable[bytes]) -> bytes | mmap.mmap:
    """All pieces as one layer: in memory, or in a temporary file that goes with the layer."""
    held, size, file = [], 0, None
    for piece in pieces:
        if file is None:
            held.append(piece)
            size += len(piece)
            if size > IN_MEMORY:
                file = tempfile.TemporaryFile()
                file.writelines(held)
                held = []
        else:
            file.write(piece)
    if file is None:
        return b"".join(held)
    file.flush()
    return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def percent_bytes(data: bytes | mmap.mmap) -> Iterator[bytes]:
    """data with its percent signs decoded. Two hexadecimal digits are no percent sign, so what is decoded never overlaps."""
    value = np.full(256, -1, np.int16)
    for digits in (b"0123456789abcdef", b"0123456789ABCDEF"):
        value[list(digits)] = range(16)
    s = 0
    while s < len(data):
        piece = data[s : s + PIECE]
        if s + len(piece) < len(data) and b"%" in piece[-2:]:
            piece = piece[: len(piece) - 2 + piece[-2:].index(b"%")]
        s += len(piece)
        codes = np.frombuffer(piece, np.uint8)
        at = np.flatnonzero(codes[:-2] == 37)
        at = at[(value[codes[at + 1]] >= 0) & (value[codes[at + 2]] >= 0)]
        out, stay = codes.copy(), np.ones(len(codes), bool)
        out[at] = value[codes[at + 1]] * 16 + value[codes[at + 2]]
        stay[at + 1] = stay[at + 2] = False
        yield out[stay].tobytes()


def escape_bytes(data: bytes | mmap.mmap) -> Iterator[bytes]:
    """data with its escapes decoded."""

    def decoded(m: re.Match) -> bytes:
        code = int(m[1] or m[2] or m[3], 16)
        return (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd").encode()

    s = 0
    while s < len(data):
        piece = data[s : s + PIECE]
        if s + len(piece) < len(data) and (cut := piece.rfind(b"\\", len(piece) - 9)) > 0:  # an escape has ten characters at most
            piece = piece[:cut]
        s += len(piece)
        yield ESCAPE_B.sub(decoded, piece)


def base64_bytes(data: bytes | mmap.mmap, start: int, end: int, skip: int) -> Iterator[bytes]:
    """The bytes of a run of base64 at one of its four alignments."""
    left = b""
    for s in range(start, end, PIECE):
        left += data[s : min(s + PIECE, end)].translate(FIRST_ALPHABET, BETWEEN)
        if skip:
            skip, left = max(0, skip - len(left)), left[skip:]
        whole = len(left) // 4 * 4
        yield base64.b64decode(left[:whole])
        left = left[whole:]
    if len(left) > 1:
        yield base64.b64decode(left + b"=" * (-len(left) % 4))


def kinds_in(data: bytes | mmap.mmap) -> Iterator[int]:
    """The kinds of base patterns that occur in a layer."""
    if any(len(m[2]) >= 6 for m in ASSIGN_B.finditer(data)):
        yield 0
    if any(m.end() - m.start() >= 20 for m in ACCESS_B.finditer(data)):
        yield 1
    if HEX_B.search(data):
        yield 2


def unwrapped(data: bytes | mmap.mmap) -> Iterator[bytes | mmap.mmap]:
    """The layers one step below a layer of bytes, each made when its turn comes."""
    if STREAM.match(data):
        yield gathered(inflate(data))
    if PERCENT_B.search(data):
        yield gathered(percent_bytes(data))
    if ESCAPE_B.search(data):
        yield gathered(escape_bytes(data))
    for m in BASE64_B.finditer(data):
        for skip in range(4):
            layer = gathered(base64_bytes(data, m.start(), m.end(), skip))
            yield layer
            for found in STREAM.finditer(layer):
                yield gathered(inflate(memoryview(layer)[found.start() :]))


def _bare(data: bytes | mmap.mmap) -> bool:
    """Whether a small layer of bytes has nothing to find or to unwrap."""
    return len(data) < PIECE and not any(p.search(data) for p in (BASE64_B, PERCENT_B, ESCAPE_B, ASSIGN_B, HEX_B)) and not STREAM.match(data)


def kinds_below(data: bytes | mmap.mmap) -> set[int]:
    """The kinds that occur in a layer or in any layer below it."""
    found, seen, work = set(), set(), [iter([data])]
    while work and len(found) < len(KINDS):
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if _bare(layer) or (mark := hashlib.sha256(layer).digest()) in seen:
            continue
        seen.add(mark)
        found.update(kinds_in(layer))
        work.append(unwrapped(layer))
    return found


def _promising(text: str) -> bool:
    """Whether a layer has something to find or to unwrap."""
    low = text.lower()
    return any(m in low for m in (*ASSIGN_MARKS, "akia")) or any(p.search(text) for p in (HEX, PERCENT, ESCAPE, BASE64))


def base64_layers(text: str) -> Iterator[Layer | Stream]:
    """Layers of a run in base64, its lines joined, at all four alignments, for it may begin after any path or word; of both
    alphabets alike. Compressed streams are sought at every byte."""
    at = np.concatenate([np.arange(m.start(), m.end(), dtype=np.int32) for m in LETTERS.finditer(text)])
    letters = "".join(LETTERS.findall(text)).replace("-", "+").replace("_", "/")
    for skip in range(4):
        bare = letters[skip:]
        bare = bare[: len(bare) - (len(bare) % 4 == 1)]
        data = base64.b64decode(bare + "=" * (-len(bare) % 4))
        n = np.arange(len(data))
        starts, ends = at[skip + n * 4 // 3], at[skip + np.minimum(len(bare) - 1, ((n + 1) * 4 + 2) // 3 - 1)] + 1
        if _promising(data.decode(errors="replace")):
            yield _utf8(data, starts, ends)
        for m in STREAM.finditer(data):
            layer = gathered(inflate(memoryview(data)[m.start() :]))
            if len(layer):
                yield layer, int(starts[m.start()]), len(text)


def layers(text: str) -> Iterator[Layer | Stream]:
    """The layers one step below text: (text, starts, ends) by character, or (bytes, start, end) of what a stream holds."""
    for mark, unwrap in ((PERCENT, percent_layer), (ESCAPE, escape_layer)):
        for m in STRETCH.finditer(text) if mark.search(text) else ():
            if mark.search(m[0]) and (layer := unwrap(m[0]))[0] and layer[0] != m[0]:
                yield layer[0], layer[1] + m.start(), layer[2] + m.start()
    for m in BASE64.finditer(text):
        for layer in base64_layers(m[0]):
            yield layer[0], layer[1] + m.start(), layer[2] + m.start()


def deep_scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end). The worklist holds what is still to unwrap, not the layers themselves; what
    has nothing more to unwrap leaves it before its last layer is entered, so a chain of layers takes no room."""
    base = scan(text)
    found, seen = set(base), set()
    rest = layers(text)
    work = [(next(rest, None), rest, None, None)]
    while work:
        layer, rest, outer_starts, outer_ends = work.pop()
        if layer is None:
            continue
        if (following := next(rest, None)) is not None:
            work.append((following, rest, outer_starts, outer_ends))
        inner, starts, ends = layer
        if isinstance(inner, str):
            if outer_starts is not None:
                starts, ends = outer_starts[starts], outer_ends[ends - 1]
            mark = (hashlib.sha256(inner.encode(errors="replace")).digest(), int(starts[0]), int(ends[-1]))
        else:
            start, end = (starts, ends) if outer_starts is None else (int(outer_starts[starts]), int(outer_ends[ends - 1]))
            mark = (hashlib.sha256(inner).digest(), start, end)
        if mark in seen:
            continue
        seen.add(mark)
        if isinstance(inner, str):
            found.update((int(starts[s]), kind, int(ends[e - 1])) for s, kind, e in scan(inner))
            below = layers(inner)
            work.append((next(below, None), below, starts, ends))
        else:
            found.update((start, kind, end) for kind in kinds_below(inner))
    return base, sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) of every whole text; counts are of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [deep_scan(t or "") for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([listed(b) for b, _ in rows], pa.string()), pa.array([listed(s) for _, s in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
