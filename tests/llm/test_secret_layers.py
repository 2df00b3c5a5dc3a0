"""Layers of secrets against a plain recursive decoder, long runs in compressed streams, and the memory that they take."""

import base64
import bz2
import gzip
import lzma
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path
from urllib.parse import quote

import pytest

from memloom.llm import secrets

SECRET = "password=hunter2222"
NEEDLES = {0: b"password=hunter2222", 1: b"AKIA" + b"Q7" * 9, 2: b"0123456789abcdef" * 2}


def plain_kinds(data, depth=0):
    """The kinds in data and below it, by recursion over whole values."""
    found = {k for k, p in enumerate((secrets.ASSIGN_B, secrets.ACCESS_B, re.compile(rb"[0-9a-f]+"))) for m in p.finditer(data) if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20, 24)[k - 1])}
    if depth > 12:
        return found
    below = []
    for opened in (lambda d: zlib.decompressobj(47).decompress(d), bz2.decompress, lzma.decompress):
        try:
            below.append(opened(data))
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            pass
    if re.search(rb"%[0-9A-Fa-f]{2}", data):
        below.append(re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data))
    if re.search(rb"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})", data):
        below.append(re.sub(rb"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))", lambda m: chr(int(m[1] or m[2], 16)).encode("utf-8", "replace"), data))
    for m in re.finditer(rb"[A-Za-z0-9+/]{16,}", data):
        for skip in range(4):
            run = m[0][skip:]
            run = run[: len(run) - (len(run) % 4 == 1)]
            below.append(base64.b64decode(run + b"=" * (-len(run) % 4)))
            below += [below[-1][s.start() :] for s in secrets.STREAM.finditer(below[-1])]
    return found.union(*(plain_kinds(b, depth + 1) for b in below if b and b != data))


WRAPS = [
    lambda d, r: gzip.compress(d), lambda d, r: zlib.compress(d), lambda d, r: bz2.compress(d), lambda d, r: lzma.compress(d), lambda d, r: b"note " + base64.b64encode(d) + b" end", lambda d, r: base64.b64encode(d),
    lambda d, r: "".join(f"%{b:02X}" for b in d).encode(), lambda d, r: quote(d, safe="").encode(), lambda d, r: "".join(f"\\x{b:02x}" if b < 128 else chr(b) for b in d).encode() if d.isascii() else d,
    lambda d, r: r.randbytes(r.randint(0, 40)) + b" " + d + b"\n" + r.randbytes(9),
]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_random_nestings_equal_a_plain_decoder(piece, monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", piece)
    monkeypatch.setattr(secrets, "IN_MEMORY", 200)  # nearly all layers are files
    rng = random.Random(piece)
    met = 0
    for _ in range(60):
        data = b" ".join(rng.sample([*NEEDLES.values(), b"plain", b"%41 x"], rng.randint(1, 3)))
        for _ in range(rng.randint(1, 5)):
            data = rng.choice(WRAPS)(data, rng)
        want, got = plain_kinds(data), secrets.kinds_below(data)
        assert got == want, data[:80]
        met += bool(want)
    assert met > 40


def test_a_long_run_crosses_every_border():
    inner = base64.b64encode(gzip.compress(random.Random(1).randbytes(170_000) + b" " + SECRET.encode()))
    for filler in ((1 << 24) - 100_000, (1 << 24) - 228_000, (1 << 20) - 7, 5):
        text = "é " + base64.b64encode(gzip.compress(b" " * filler + b"\n" + inner + b"\n" + b"- " * 900_000)).decode()
        assert secrets.deep_scan(text)[1] == [(2, 0, len(text.rstrip('=')))]


def test_kinds_at_borders_and_long_blanks(monkeypatch):
    wide = b"secret" + b" " * 3_000_000 + b":" + b" " * 3_000_000 + b"abcdef"
    assert secrets.kinds_below(wide) == {0}
    assert secrets.kinds_below(b"secret: token: abcdefgh") == set()  # the failing match takes the second word
    assert secrets.kinds_below(b"z" * 99 + b"0123456789abcdef" * 200_000) == {2}
    wrapped = b"\n".join(re.findall(b".{1,76}", base64.b64encode(b"x " * 2_000_000 + SECRET.encode())))
    assert 0 in secrets.kinds_below(wrapped)


def test_memory_of_a_large_stream():
    """A text of some 100 kB that holds 128 MB, with a secret in base64 at its end, in a process of its own."""
    code = (
        "import zlib, base64, resource\nfrom memloom.llm import secrets\nc = zlib.compressobj(9)\nparts = [c.compress(b'- ' * (1 << 19)) for _ in range(128)]\n"
        "parts.append(c.compress(b'\\n' + base64.b64encode(b'password=hunter2222')))\ntext = base64.b64encode(b''.join(parts) + c.flush()).decode()\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nassert secrets.deep_scan(text)[1] == [(0, 0, len(text.rstrip('=')))]\n"
        "anon = sum(int(x.split()[1]) for x in open('/proc/self/smaps_rollup') if x.startswith('Pss_Anon'))\nprint(anon // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=600, check=True)
    assert int(done.stdout) < 150


def test_rows_that_repeat_and_further_columns(spark):
    text = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    bare = text.rstrip("=")
    rows = [(1, text, "x"), (1, text, "y"), (None, SECRET, "z"), (2, SECRET + " " + "a b " * 300_000 + text, "w")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_assign string")).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.spans) for r in got) == sorted([("1", 0, f"assign:0:{len(bare)}")] * 2 + [("None", 1, "assign:0:19"), ("2", 1, f"assign:0:19,assign:{20 + 1_200_000}:{20 + 1_200_000 + len(bare)}")])
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
