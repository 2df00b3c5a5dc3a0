"""Token-id files of patched frame-of-reference blocks.

A file is a run of segments. A segment holds, all little-endian:
header (magic, documents, ids, blocks: 4 u64), document ids (i64; the least value for null),
ids per document (u64), block minima (u32), widths (u8), exceptions per block (u8), block
starts (u64, one more than blocks, in bytes of the body), and the body. A block of 128 ids is
its differences from the minimum, packed at the width that 90 % of them fit, then the
positions (u8) and high parts (u32) of the others.

Defined cases: a null or empty text has only the end id; repeated document ids keep one entry
each, next to each other; null document ids come first; an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import scratch, stored
from memloom.llm.tokens import tokenizer

BLOCK, QUANTILE, MAGIC = 128, 0.9, 0x31_52_4F_46_50  # PFOR1
NULL_ID = np.iinfo(np.int64).min
#: Characters of text that a segment covers, but for one longer text.
SEGMENT_CHARS = 4_000_000


def _pack(diffs: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2 ** width as rows of 2 * width 64-bit words."""
    words = np.zeros((len(diffs), BLOCK * width // 64), np.uint64)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 64)
        words[:, word] |= diffs[:, i] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= diffs[:, i] >> np.uint64(64 - bit)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), np.uint64)
    for i in range(BLOCK if width else 0):
        word, bit = divmod(i * width, 64)
        out[:, i] = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            out[:, i] |= words[:, word + 1] << np.uint64(64 - bit)
    return out & np.uint64((1 << width) - 1)


def encode_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n = -(-len(ids) // BLOCK)
    values = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(n, BLOCK)
    minima = values.min(1) if n else np.zeros(0, np.uint32)
    diffs = (values - minima[:, None]).astype(np.uint64)
    bits = np.zeros(diffs.shape, np.uint8)
    for b in range(32):
        bits += diffs >= np.uint64(1 << b)
    rank = int(QUANTILE * BLOCK)
    widths = np.partition(bits, rank, axis=1)[:, rank] if n else np.zeros(0, np.uint8)
    odd_block, odd_at = np.nonzero(bits > widths[:, None])
    odd = np.bincount(odd_block, minlength=n)
    high = (diffs[odd_block, odd_at] >> widths[odd_block].astype(np.uint64)).astype("<u4")
    starts = np.concatenate(([0], np.cumsum(widths.astype(np.int64) * (BLOCK // 8) + odd * 5)))
    body = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        packed = _pack(diffs[own] & np.uint64((1 << width) - 1), width).astype("<u8").view(np.uint8)
        body[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    patch = starts[:-1] + widths.astype(np.int64) * (BLOCK // 8)
    order = np.arange(len(odd_block)) - np.repeat(np.cumsum(odd) - odd, odd)
    body[patch[odd_block] + order] = odd_at
    body[(patch[odd_block] + odd[odd_block] + 4 * order)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    header = np.array([MAGIC, len(doc_ids), len(ids), n], "<u8")
    return b"".join(x.tobytes() for x in (header, doc_ids.astype("<i8"), counts.astype("<u8"), minima.astype("<u4"), widths, odd.astype(np.uint8), starts.astype("<u8"), body))


def decode_segment(read: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(document ids, ids per document, ids) of the next segment; None at the end. read(n) gives the next n bytes."""
    head = read(32)
    if not head:
        return None
    magic, n_docs, n_ids, n = np.frombuffer(head, "<u8").tolist()
    if magic != MAGIC:
        raise ValueError("not a token-id segment")
    doc_ids, counts, minima, widths, odd, starts = (np.frombuffer(read(k * np.dtype(t).itemsize), t) for k, t in ((n_docs, "<i8"), (n_docs, "<u8"), (n, "<u4"), (n, "u1"), (n, "u1"), (n + 1, "<u8")))
    starts, odd = starts.astype(np.int64), odd.astype(np.int64)
    body = np.frombuffer(read(int(starts[-1])), np.uint8)
    diffs = np.zeros((n, BLOCK), np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        diffs[own] = _unpack(body[starts[own][:, None] + np.arange(width * BLOCK // 8)].view("<u8"), width)
    block = np.repeat(np.arange(n), odd)
    order = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
    patch = starts[:-1] + widths.astype(np.int64) * (BLOCK // 8)
    at = body[patch[block] + order]
    high = body[(patch[block] + odd[block] + 4 * order)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    diffs[block, at] |= high.astype(np.uint64) << widths[block].astype(np.uint64)
    return doc_ids, counts.astype(np.int64), (diffs + minima[:, None]).astype(np.uint32).ravel()[:n_ids]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    keys, texts, chars = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and chars + len(text or "") > SEGMENT_CHARS:
                yield keys, texts
                keys, texts, chars = [], [], 0
            keys.append(key)
            texts.append(text or "")
            chars += len(texts[-1])
    if texts:
        yield keys, texts


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes every text's ids, end_id after each, in ascending order of id_col, and returns the manifest:
    (shard, path, n_docs, n_ids, base), base being the ids in all shards before.

    A shard is a range of ids; a repeated task writes a new file, and the manifest names the one that counts.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    ordered = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).repartitionByRange("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, n_docs, n_ids = TaskContext.get().partitionId(), None, 0, 0
        for keys, texts in _segments(batches):
            if out is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}.pfor"
                out = store.open_output_stream(f"{root}/{name}")
            ids, counts = tokenizer(vocabulary).encode(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            out.write(encode_segment(np.array([NULL_ID if k is None else k for k in keys], np.int64), counts + 1, ids))
            n_docs, n_ids = n_docs + len(keys), n_ids + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    manifest = stored(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "manifest")
    # one row for each file: small at any size of the table
    return manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, root = fs.FileSystem.from_uri(path)
                with store.open_input_stream(root) as f:
                    while segment := decode_segment(f.read):
                        doc_ids, counts, ids = segment
                        ends = np.cumsum(counts)
                        data = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += len(ids)

    files = manifest.select("path", "base")
    return files.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
