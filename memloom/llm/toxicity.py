"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word, or each overlapping piece of a long one, enters as a vector of its own (words of the training sample only) beside the mean of its
character trigrams' vectors. Texts are read in both directions; attention pools the states of each
window of WINDOW words to one logit; a document's score is the highest logit of its windows, one at
every start, calibrated on the training sample. Only training takes windows that are each STRIDE
after the last, and reads each by itself.

Training takes a bounded sample of labelled rows (SAMPLE documents of at most SAMPLE_CHARS
characters, drawn by a hash of the id). Each round takes the window of every document that scores
highest so far, so that a label says something about one window only.

Defined cases: null, empty and wordless texts are scored as one empty window; a table without
labelled rows gets the same score, 0, everywhere; labels that disagree count as toxic; a null id
is never held out; repeated rows are scored alike, a row each, and train once; scores at the
threshold are predicted toxic; an empty table of documents gives an empty one; texts are scored whole,
however long; other columns are ignored, and kept by `without_toxic`, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from memloom.llm.common import held

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 64, 48, 8, 8, 8
SAMPLE, SAMPLE_CHARS, LEAST_DOCS, ROUNDS, BATCH, RATE, DECAY, SEED = 4000, 20_000, 5, 6, 128, 0.01, 0.02, 7
#: Small samples take more rounds, for this many steps at least, and count words of fewer documents.
LEAST_STEPS = 100
MOST_TRIGRAMS, ACCEPT = 16, 0.7
#: Bytes of a piece of a long word: as many as have MOST_TRIGRAMS trigrams with the marks at both ends, so none is left out.
PIECE = MOST_TRIGRAMS
#: Distinct words that a worker keeps, windows that training reads at once, and bytes of texts (or one text) that scoring does.
CACHE, LANES, READ_BYTES = 150_000, 512, 8_000_000
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text; one of over PIECE bytes as pieces of PIECE bytes that overlap by half, so that all of it is read."""
    words = (text or b"").translate(FOLD).split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def trigrams(word: bytes) -> list[bytes]:
    padded = b"<" + word + b">"
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))[:MOST_TRIGRAMS]


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of every window, for documents of counts words one after another."""
    each = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), each)
    inside = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    return doc, (np.cumsum(counts) - counts)[doc] + inside, np.clip(counts[doc] - inside, 0, WINDOW)


class Model(NamedTuple):
    """words and chars give rows of word and char; row 0 stands for all others. Both directions lie along axis 0 of U."""

    words: dict
    chars: dict
    p: dict  # word (V, Dw), char (C, Dc), W (Dw + Dc, 6H), b (6H), U (2, H, 3H), A (2H, H), v (H), o (2H), c (1)
    scale: float
    shift: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _inputs(p: dict, word: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gate inputs of words (rows of word, and of tri padded with -1), the vectors they come from, and the trigram counts."""
    n = np.maximum(1, (tri >= 0).sum(1, keepdims=True)).astype(np.float32)
    chars = np.zeros((len(tri), CHAR_DIM), np.float32)
    for column in tri.T:
        chars += p["char"][column] * (column >= 0)[:, None]
    chars /= n
    vectors = np.concatenate([p["word"][word], chars], 1)
    return vectors @ p["W"] + p["b"], vectors, n


def forward(p: dict, x: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows. x: (T, 2, B, 3H), the second direction in reverse; live: (T, 2, B, 1), 0 for padding."""
    steps, _, lanes, _ = x.shape
    h, hidden = np.zeros((2, lanes, HIDDEN), np.float32), np.zeros((steps + 1, 2, lanes, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        own = h @ p["U"]
        gates = _sigmoid(x[t, ..., : 2 * HIDDEN] + own[..., : 2 * HIDDEN])
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        n = np.tanh(x[t, ..., 2 * HIDDEN :] + r * own[..., 2 * HIDDEN :])
        h = h + live[t] * (1 - z) * (n - h)
        hidden[t + 1] = h
        if keep:
            kept.append((z, r, n, own[..., 2 * HIDDEN :]))
    states = np.concatenate([hidden[1:, 0], hidden[:0:-1, 1]], -1)  # (T, B, 2H), both in reading order
    look = np.tanh(states @ p["A"])
    weight = look @ p["v"] + np.where(live[:, 0, :, 0] > 0, 0, -1e9).astype(np.float32)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ p["o"] + p["c"][0], (hidden, kept, states, look, weight, pooled)


def backward(p: dict, x: np.ndarray, live: np.ndarray, state: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters above the inputs, and of x."""
    hidden, kept, states, look, weight, pooled = state
    g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["o"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_look = d_score[..., None] * p["v"] * (1 - look * look)
    g["v"] = np.einsum("tb,tbh->h", d_score, look)
    g["A"] = np.einsum("tbi,tbj->ij", states, d_look)
    d_states = weight[..., None] * d_pooled + d_look @ p["A"].T
    d_hidden = np.stack([d_states[..., :HIDDEN], d_states[::-1, :, HIDDEN:]], 1)
    d_x, g["U"] = np.zeros_like(x), np.zeros_like(p["U"])
    d_h = np.zeros_like(hidden[0])
    for t in range(len(x) - 1, -1, -1):
        d_h = d_h + d_hidden[t]
        z, r, n, own = kept[t]
        before, on = hidden[t], live[t] * d_h
        d_n = on * (1 - z) * (1 - n * n)
        d_z = on * (before - n) * z * (1 - z)
        d_r = d_n * own * r * (1 - r)
        d_own = np.concatenate([d_z, d_r, d_n * r], -1)
        d_x[t] = np.concatenate([d_z, d_r, d_n], -1)
        g["U"] += before.transpose(0, 2, 1) @ d_own
        d_h = d_h * (1 - live[t]) + on * z + d_own @ p["U"].transpose(0, 2, 1)
    return g, d_x


def gather(table: np.ndarray, codes: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, live, where) for forward, from gate inputs (rows of 6H) and each window's place in codes; where is the row of every cell, both ways."""
    steps = np.arange(max(1, int(n.max(initial=1))))[:, None]
    at, back = np.minimum(first + steps, max(0, len(codes) - 1)), np.clip(first + len(steps) - 1 - steps, 0, max(0, len(codes) - 1))
    none = np.zeros(at.shape, np.int64)
    where = np.stack([codes[at], codes[back]], 1) if len(codes) else np.stack([none, none], 1)
    live = np.stack([steps < n, len(steps) - 1 - steps < n], 1)[..., None].astype(np.float32)
    x = np.stack([table[where[:, 0], : 3 * HIDDEN], table[where[:, 1], 3 * HIDDEN :]], 1)
    return x, live, where


class Reader:
    """Words to rows of gate inputs; new words are added as they come."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def codes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > CACHE:
            self.rows, self.table = {}, self.table[:0]
        each = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        known, add = len(self.rows), self.rows.setdefault
        codes = np.fromiter((add(w, len(self.rows)) for words in each for w in words), np.int64, int(counts.sum()))
        new = list(self.rows)[known:]
        if new:
            word, tri = encode_words(new, self.model.words, self.model.chars)
            self.table = np.concatenate([self.table, _inputs(self.model.p, word, tri)[0]])
        return codes, counts


def encode_words(words: list[bytes], rows: dict, chars: dict) -> tuple[np.ndarray, np.ndarray]:
    tri = np.full((len(words), MOST_TRIGRAMS), -1, np.int32)
    for i, w in enumerate(words):
        own = [chars.get(t, 0) for t in trigrams(w)]
        tri[i, : len(own)] = own
    return np.fromiter((rows.get(w, 0) for w in words), np.int64, len(words)), tri


def window_sums(x: np.ndarray) -> np.ndarray:
    """The sum of each run of WINDOW numbers of x, added by doubling, so that nothing cancels out."""
    out, done, width = np.zeros(len(x) - WINDOW + 1), 0, 1
    while width <= WINDOW:
        if WINDOW & width:
            out += x[done : done + len(out)]
            done += width
        x = x[:-width] + x[width:] if width * 2 <= WINDOW else x
        width *= 2
    return out


def text_logits(p: dict, table: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each document's highest logit over the windows at every start. The recurrence runs once over a document in both
    directions, and all windows share its states, so what stands before a passage doesn't move the windows that hold it."""
    first, order = np.cumsum(counts) - counts, np.argsort(-counts, kind="stable")
    states = np.zeros((len(codes), 2 * HIDDEN), np.float32)
    h = np.zeros((2, len(counts), HIDDEN), np.float32)
    begin, last, longest_first = first[order], (first + counts - 1)[order], counts[order]
    for t in range(int(counts.max(initial=0))):
        lanes = int(np.searchsorted(-longest_first, -t))  # documents of more than t words
        ahead, back = begin[:lanes] + t, last[:lanes] - t
        x = np.stack([table[codes[ahead], : 3 * HIDDEN], table[codes[back], 3 * HIDDEN :]])
        h = h[:, :lanes]
        own = h @ p["U"]
        gates = _sigmoid(x[..., : 2 * HIDDEN] + own[..., : 2 * HIDDEN])
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        h = h + (1 - z) * (np.tanh(x[..., 2 * HIDDEN :] + r * own[..., 2 * HIDDEN :]) - h)
        states[ahead, :HIDDEN], states[back, HIDDEN:] = h
    room = np.maximum(counts, WINDOW)  # short documents are one window
    place = np.cumsum(room) - room
    at = np.arange(len(codes)) + np.repeat(place - first, counts)
    weight, pull = np.zeros(int(room.sum())), np.zeros(int(room.sum()))
    for i in range(0, len(codes), 65_536):
        part = states[i : i + 65_536]
        weight[at[i : i + 65_536]] = w = np.exp((np.tanh(part @ p["A"]) @ p["v"]).astype(float))
        pull[at[i : i + 65_536]] = w * (part @ p["o"])
    weight = window_sums(weight) if len(weight) else weight
    logits = np.divide(window_sums(pull), weight, out=np.zeros_like(weight), where=weight > 0) if len(pull) else pull
    inside = np.arange(len(logits)) - np.repeat(place, room)[: len(logits)]
    logits[inside > np.repeat(room, room)[: len(logits)] - WINDOW] = -np.inf
    return (np.maximum.reduceat(logits, place) if len(counts) else logits) + p["c"][0]


def best_logits(model_p: dict, table: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(each document's highest window logit, the window that has it, all windows)."""
    doc, first, n = spans = windows(counts)
    if not len(table):
        table = np.zeros((1, 6 * HIDDEN), np.float32)
    logits = np.zeros(len(doc), np.float32)
    order = np.argsort(n, kind="stable")  # short windows together: fewer steps
    for i in range(0, len(order), LANES):
        own = order[i : i + LANES]
        x, live, _ = gather(table, codes, first[own], n[own])
        logits[own] = forward(model_p, x, live)[0]
    ranked = np.lexsort((-logits, doc))
    top = ranked[np.searchsorted(doc[ranked], np.arange(len(counts)))]
    return logits[top], top, spans


def train(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model for texts and their labels (0 or 1), calibrated on every fifth text, which takes no part in
    training; the same inputs give the same model."""
    apart = np.arange(len(texts)) % 5 == 4
    if len(set(labels[apart].tolist())) == 2:
        model = _fit([t for t, a in zip(texts, apart, strict=True) if not a], labels[~apart], rounds)
        reader = Reader(model)
        codes, counts = reader.codes([t for t, a in zip(texts, apart, strict=True) if a])
        return model._replace(**calibration(text_logits(model.p, reader.table, codes, counts), labels[apart]))
    return _fit(texts, labels, rounds)


def _fit(texts: list[bytes], labels: np.ndarray, rounds: int) -> Model:
    rng = np.random.default_rng(SEED)
    rounds = max(rounds, -(-LEAST_STEPS // max(1, len(texts) // BATCH)))
    least = max(4, min(LEAST_DOCS, len(texts) // 100))
    seen: dict[bytes, list[int]] = {}
    grams: dict[bytes, int] = {}
    row: dict[bytes, int] = {}
    each = []
    for text, label in zip(texts, labels.tolist(), strict=True):
        words = words_of(text)
        each.append(np.fromiter((row.setdefault(w, len(row)) for w in words), np.int32, len(words)))
        for w in set(words):
            seen.setdefault(w, [0, 0])[label] += 1
        for g in {g for w in set(words) for g in trigrams(w)}:
            grams[g] = grams.get(g, 0) + 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if sum(n) >= least))}
    chars = {g: i + 1 for i, g in enumerate(sorted(g for g, n in grams.items() if n >= least))}
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"word": draw(len(vocabulary) + 1, WORD_DIM, s=0.1), "char": draw(len(chars) + 1, CHAR_DIM, s=0.1), "W": draw(WORD_DIM + CHAR_DIM, 6 * HIDDEN, s=0.3), "b": np.zeros(6 * HIDDEN, np.float32), "U": draw(2, HIDDEN, 3 * HIDDEN, s=0.2), "A": draw(2 * HIDDEN, HIDDEN, s=0.3), "v": draw(HIDDEN, s=0.3), "o": draw(2 * HIDDEN, s=0.3), "c": np.zeros(1, np.float32)}
    totals = np.bincount(labels, minlength=2) + 1
    for w, i in vocabulary.items():  # a first guess for one dimension: the smoothed log-odds of the label where the word occurs
        clean, toxic = seen[w]
        p["word"][i, 0] = np.clip(np.log((toxic + 0.5) / totals[1]) - np.log((clean + 0.5) / totals[0]), -3, 3) / 2
    word, tri = encode_words(list(row), vocabulary, chars)
    counts = np.fromiter(map(len, each), np.int64, len(each))
    codes = np.concatenate(each)
    del seen, grams, row, each
    doc, first, n = windows(counts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    chosen = np.unique(rng.permutation(len(doc))[: 2 * len(texts)])
    for k in range(rounds):
        if k:
            top = best_logits(p, _inputs(p, word, tri)[0], codes, counts)[1]
            chosen = np.union1d(top, rng.permutation(np.flatnonzero(labels[doc] == 0))[: len(texts) // 4])
        chosen = chosen[n[chosen] > 0]
        for own in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
            cells, local = np.unique(np.concatenate([codes[a : a + m] for a, m in zip(first[own], n[own], strict=True)]), return_inverse=True)
            table, vectors, n_tri = _inputs(p, word[cells], tri[cells])
            x, live, where = gather(table, local, np.cumsum(n[own]) - n[own], n[own])
            logit, state = forward(p, x, live, keep=True)
            label = labels[doc[own]]
            g, d_x = backward(p, x, live, state, ((_sigmoid(logit) - label) / len(own)).astype(np.float32))
            d_x *= live
            d_table = np.zeros_like(table)
            np.add.at(d_table[:, : 3 * HIDDEN], where[:, 0], d_x[:, 0])
            np.add.at(d_table[:, 3 * HIDDEN :], where[:, 1], d_x[:, 1])
            g |= {"W": vectors.T @ d_table, "b": d_table.sum(0), "word": np.zeros_like(p["word"]), "char": np.zeros_like(p["char"])}
            d_vectors = d_table @ p["W"].T
            np.add.at(g["word"], word[cells], d_vectors[:, :WORD_DIM])
            i, j = np.nonzero(tri[cells] >= 0)
            np.add.at(g["char"], tri[cells][i, j], (d_vectors[:, WORD_DIM:] / n_tri)[i])
            step += 1
            for name, grad in g.items():
                m, s = moments[name]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                p[name] -= (RATE * (1 - k / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6) + RATE * DECAY * p[name]).astype(np.float32)
    return Model(vocabulary, chars, p, 1.0, 0.0)


def calibration(logits: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """scale and shift of the logistic fit of labels on logits, by Newton's method with a ridge toward leaving them as they are."""
    a, x = np.array([1.0, 0.0]), np.stack([logits, np.ones_like(logits)], 1)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (q - labels) + a - [1, 0])
        a = a - np.clip(step, -0.5, 0.5)  # short steps, so it can't run away where labels are cleanly apart
    return {"scale": float(np.clip(a[0], 0.05, 5)), "shift": float(a[1])}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of about sample labelled documents that aren't held out, and have at most SAMPLE_CHARS characters; a
    document comes once, however many rows repeat it, so the sample's size has no other bound."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000))
    picked = known.where(slot < int(1_000_000 * min(1.0, sample / max(1, n))))
    # one row of two columns for each of about sample documents: of several rows of one id, the least text
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).select("doc_id", F.col("text").cast("binary").alias("t"))
    rows = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).orderBy("doc_id").collect()
    return [bytes(r.t or b"") for r in rows], np.array([r.toxic for r in rows], np.int64)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with __score (0 to 1, higher where the label 1 is likelier) and __predicted (1 from ACCEPT on)."""
    texts, known = training_sample(docs, labels)
    model = train(texts, known) if len(texts) and known.any() and not known.all() else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most one row for each frequent word or trigram of the sample
    place, mark = docs.columns.index("text"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = held(("toxicity", mark), lambda: Reader(model)) if model else None
        for batch in batches:
            texts, scores = batch.column(place).cast(pa.binary()), np.zeros(batch.num_rows)
            till = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.unique(np.searchsorted(till, np.arange(0, int(till[-1]) if len(till) else 0, READ_BYTES), "right"))
            cuts = [0, *cuts[cuts > 0].tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False) if reader else ():
                codes, counts = reader.codes(texts.slice(i, j - i).to_pylist())
                logits = text_logits(model.p, reader.table, codes, counts)
                scores[i:j] = 1 / (1 + np.exp(-np.clip(model.scale * logits + model.shift, -30, 30)))
            added = [pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "__score", "__predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType()), StructField("__predicted", IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    return scored(docs.select("doc_id", "text"), labels).select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)))  # so that no name meets the score's
    return scored(plain, labels).where("__predicted = 0").drop("__score", "__predicted").toDF(*names)
