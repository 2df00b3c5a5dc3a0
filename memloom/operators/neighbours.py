"""Neighbours by cells: vectors are stored by the coarse centroid that they are nearest to, and searches read the cells they need.

A cell knows the greatest angle between its centroid and its vectors, so by the triangle inequality of angles no vector of it is
more similar to a query than the cosine of the angle to the centroid less that. Searches are exact by default: the nearest cells
are read first, then those whose bound reaches what was found. With `probes` only so many nearest cells are read, which misses
some neighbours; tests measure the recall.

Centroids are fitted on a sample of SAMPLE vectors at most, dealt evenly over all rows by a hash; every vector is indexed.
What is broadcast, and what the driver holds, is centroids and cells, bounded by MOST_CELLS.

Defined cases: scores are those of `functions.vectors.cosine`, ties go by id; zero vectors and vectors of another length than most
have a cell of their own; zero queries score 0 everywhere; an empty table has no cells and no neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.vectors import cosine, norm
from memloom.sources.shared import kept

#: Vectors that centroids are fitted on, rounds of fitting, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: The cell of vectors without a direction that can be compared.
ODD = -1
#: Vectors and queries that meet in one block.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 16_384
#: Products, and numbers of vectors, that a block is worked on at once.
AT_ONCE = 1 << 21
#: What rounding may move an angle, and a cosine, by.
SLACK = 1e-6


def units(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1))
    return rows / np.where(size > 0, size, 1)[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_centroids(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids, by spherical k-means on at most `sample` vectors of the commonest length. There are a quarter of the
    root of all rows of them, unless cells says otherwise."""
    good = vectors.where(norm(F.col("vec")) > 0)
    top = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if top is None:
        return np.zeros((0, 0))
    share = min(1.0, sample / top["count"])
    taken = good.where(F.size("vec") == top.n).where(F.pmod(F.xxhash64("namespace", "id"), F.lit(1_000_000)) < int(np.ceil(1_000_000 * share)))
    rows = units(matrix(taken.orderBy(F.xxhash64("id", "namespace")).limit(sample).select("vec").toArrow().column("vec")))  # a bounded sample
    k = max(1, min(MOST_CELLS, len(rows), cells or round(top["count"] ** 0.5 / 4)))
    centroids = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = np.sqrt((sums * sums).sum(1)) < 1e-9
        centroids = np.where(empty[:, None], centroids, units(sums))
    return centroids


def with_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (namespace, id, vec) with the cell of each and its angle to the cell's centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            cell, angle = np.full(len(column), ODD, np.int32), np.zeros(len(column))
            fits = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width) if width else np.zeros(0, int)
            rows = units(matrix(column.take(pa.array(fits)))) if len(fits) else np.zeros((0, width))
            live = np.abs(rows).max(1, initial=0) > 0
            scores = rows[live] @ shared.value.T
            cell[fits[live]], angle[fits[live]] = scores.argmax(1), np.arccos(np.clip(scores.max(1, initial=-1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    plain = vectors.select("namespace", "id", "vec")
    return plain.mapInArrow(run, plain.withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0)).schema)


@dataclass
class CellIndex:
    """A stored index: `cells` (id, vec by namespace and cell), `facts` (rows and greatest angle of each cell of a namespace)."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Writes the index of vectors (namespace, id, vec) to a new folder."""
        spark, centroids = vectors.sparkSession, fit_centroids(vectors, cells, sample)
        with_cells(vectors, centroids).write.partitionBy("namespace", "cell").parquet(f"{path}/cells")
        rows = [(k, c.tolist()) for k, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = CellIndex(spark, path, centroids)
        index._cells().groupBy("namespace", "cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).write.parquet(f"{path}/facts")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> CellIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        return CellIndex(spark, path, np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0)))

    def _cells(self) -> DataFrame:
        schema = "id string, vec array<float>, angle double, namespace string, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells")

    def _facts(self, namespace: str | None) -> list:
        facts = self.spark.read.parquet(f"{self.path}/facts")
        facts = facts.where(F.col("namespace") == namespace) if namespace is not None else facts
        return facts.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("angle").alias("angle")).orderBy("cell").collect()  # MOST_CELLS and one at most

    def cells(self, namespace: str | None, wanted: Sequence[int] | None = None) -> DataFrame:
        """The vectors of some cells; the others' files aren't read."""
        rows = self._cells()
        rows = rows.where(F.col("namespace") == namespace) if namespace is not None else rows
        return rows.where(F.col("cell").isin([int(c) for c in wanted])) if wanted is not None else rows

    def _best(self, namespace: str, cells: Sequence[int], query: Sequence[float], k: int) -> DataFrame:
        score = cosine(F.col("vec"), F.array(*map(F.lit, map(float, query))))
        return self.cells(namespace, cells).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def nearest(self, namespace: str, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, score, vec_rank): the k best of a namespace by cosine, ties by id; of its `probes` nearest cells only, where given."""
        facts, k = self._facts(namespace), max(0, k)
        q = units(np.array([query], float))[0]
        bounds = upper_bounds(q[None], self.centroids, {f.cell: f.angle for f in facts})[0]
        centre = {f.cell: float(q @ self.centroids[f.cell]) if f.cell != ODD and len(q) == self.centroids.shape[1] else 0.0 for f in facts}
        order = sorted((f.cell for f in facts), key=lambda c: (-centre[c], c))
        if probes is None and k:
            first, held = [], 0
            rows = {f.cell: f.rows for f in facts}
            for c in order:
                if held >= k:
                    break
                first.append(c)
                held += rows[c]
            worst = self._best(namespace, first, query, k).agg(F.min("score").alias("s"), F.count("*").alias("n")).first() if first else None
            order = [c for c in order if c in first or worst is None or worst.n < k or bounds[c] >= worst.s - SLACK]
        else:
            order = order[: max(0, probes or 0)]
        best = self._best(namespace, order, query, k)
        return best.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def upper_bounds(queries: np.ndarray, centroids: np.ndarray, angles: dict[int, float]) -> list[dict[int, float]]:
    """For each of some unit queries, and each cell of angles: what no cosine with a vector of the cell is above."""
    cells = [c for c in angles if c != ODD]
    odd = 0.0 if queries.shape[1] == centroids.shape[1] else 1.0  # vectors of another length may be of the query's
    out = [{ODD: odd} if ODD in angles else {} for _ in queries]
    if not cells:
        return out
    if queries.shape[1] != centroids.shape[1]:
        return [x | dict.fromkeys(cells, 0.0) for x in out]
    to = np.arccos(np.clip(queries @ centroids[cells].T, -1, 1)) - np.array([angles[c] for c in cells]) - SLACK
    bound = np.cos(np.clip(to, 0, np.pi))
    return [x | dict(zip(cells, b.tolist(), strict=True)) for x, b in zip(out, bound, strict=True)]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first number to the last, as the column expression sums them."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def singles(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as rows of 32-bit floats."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def norms_and_units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms as the column expression has them, and unit vectors as 32-bit floats; some rows at once."""
    norms, unit = np.zeros(len(rows)), np.zeros_like(rows)
    step = max(1, AT_ONCE // max(1, rows.shape[1]))
    for a in range(0, len(rows), step):
        part = rows[a : a + step].astype(np.float64)
        norms[a : a + step] = np.sqrt(in_order(part, part))
        unit[a : a + step] = units(part)
    return norms, unit


def best_of_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score): the k best of a block of vectors for each of a block of queries, of those with a score of `least` or more
    where a query has that. Products of 32-bit floats find what may be among them, some queries at once, so memory is bounded;
    scores are then worked out in the order of the column expression, so they are the same to the last bit."""
    schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float32())])
    if not queries.num_rows or not vectors.num_rows or k < 1:
        return schema.empty_table()
    names = vectors.column("id").combine_chunks()
    rank = np.zeros(len(names), np.int64)
    rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    ask, have = (t.column(c).combine_chunks() for t, c in ((queries, "qvec"), (vectors, "vec")))
    wide, long = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in (ask, have))
    least = queries.column("least").to_numpy().astype(np.float32) if "least" in queries.column_names else np.full(len(ask), np.nan, np.float32)
    out: list[list] = [[], [], []]
    for width in np.unique(wide).tolist():
        rows, own = np.flatnonzero(wide == width), np.flatnonzero(long == width)
        zero = np.flatnonzero(long != width)
        zero = zero[np.argsort(rank[zero])[:k]]  # these score 0
        q, v = (singles(c.take(pa.array(n))).reshape(len(n), width) for c, n in ((ask, rows), (have, own)))
        (q_norm, q_unit), (v_norm, v_unit) = norms_and_units(q), norms_and_units(v)
        slack = SLACK + (width + 4) * 2.0**-23  # what rounding to 32 bits may move a product by, twice over
        step, pairs = max(1, AT_ONCE // max(1, len(own))), max(1, AT_ONCE // max(1, width))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            rough = q_unit[a : a + step] @ v_unit.T
            floor = np.where(np.isnan(least[part]), np.float32(-2), least[part])
            unknown = np.flatnonzero(floor == -2)
            if k < len(own) and len(unknown):
                floor[unknown] = np.partition(rough[unknown], -k, 1)[:, -k]
            i, j = np.nonzero(rough >= (floor - slack).astype(np.float32)[:, None])
            exact = np.zeros(len(i), np.float32)
            for b in range(0, len(i), pairs):
                at, to = i[b : b + pairs] + a, j[b : b + pairs]
                whole = q_norm[at] * v_norm[to]
                exact[b : b + pairs] = np.where(whole > 0, in_order(q[at].astype(np.float64), v[to].astype(np.float64)) / np.where(whole > 0, whole, 1), 0)
            i, at = np.concatenate([i, np.repeat(np.arange(len(part)), len(zero))]), np.concatenate([own[j], np.tile(zero, len(part))])
            scores = np.concatenate([exact, np.zeros(len(at) - len(exact), np.float32)])
            order = np.lexsort((rank[at], -scores, i))
            i, at, scores = i[order], at[order], scores[order]
            good = (np.arange(len(i)) - np.searchsorted(i, i) < k) & ~(scores < least[part][i])
            out[0].append(part[i[good]])
            out[1].append(at[good])
            out[2].append(scores[good])
    asked, found, scores = (np.concatenate(x) for x in out)
    return pa.Table.from_arrays([queries.column("query_id").combine_chunks().take(pa.array(asked)), names.take(pa.array(found)), pa.array(scores)], schema=schema)


def bundled(rows: dict[int, int]) -> dict[int, int]:
    """For each of some cells, given their rows, the first cell of its bundle: cells in a row that fill a block together."""
    out, first, held = {}, None, 0
    for cell in sorted(rows):
        if first is None or held + rows[cell] > BLOCK_VECTORS:
            first, held = cell, 0
        out[cell], held = first, held + rows[cell]
    return out


def _blocks(index: CellIndex, namespace: str | None, asked: DataFrame, k: int, rows: dict[int, int], bundle: dict[int, int]) -> DataFrame:
    """The k best for asked (query_id, qvec, least, bundle) in each block of a bundle of cells: vectors and queries of a bundle are dealt to
    as many parts as their numbers need, and every part of the one meets every part of the other once, so no group grows with the data."""
    held: dict[int, int] = {}
    for cell, b in bundle.items():
        held[b] = held.get(b, 0) + rows[cell]
    cells = index.spark.createDataFrame(sorted(bundle.items()), "cell int, bundle int")  # a row for each cell, as the next
    parts = index.spark.createDataFrame([(b, -(-n // BLOCK_VECTORS)) for b, n in held.items()], "bundle int, vparts long")
    sizes = asked.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("qparts")).join(F.broadcast(parts), "bundle")
    left = asked.join(F.broadcast(sizes), "bundle").withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.col("qparts"))).withColumn("vpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vparts") - 1)))
    right = index.cells(namespace).join(F.broadcast(cells), "cell").join(F.broadcast(sizes), "bundle").withColumn("vpart", F.pmod(F.xxhash64("id"), F.col("vparts"))).withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qparts") - 1)))
    block = ("bundle", "vpart", "qpart")
    left, right = left.select(*block, "query_id", "qvec", "least"), right.select(*block, "id", "vec")
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(lambda a, b: best_of_block(a, b, k), "query_id string, id string, score float")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_join(queries: DataFrame, index: CellIndex, k: int = 1, namespace: str | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, place): the k best vectors of an index, or of a namespace of it, for each of any number of queries (query_id,
    qvec; distinct ids), ties by id. Queries go to their nearest cells first, then, with the least score they found there, to all cells
    whose bound reaches that; these are bundled, so a query goes to a block of vectors once, not for each of its cells. With
    probes, only the nearest cells are read."""
    facts = index._facts(namespace)
    angles = {f.cell: f.angle for f in facts}
    rows = {f.cell: f.rows for f in facts}
    alone, bundle = {c: c for c in rows}, bundled(rows)
    shared = index.spark.sparkContext.broadcast((index.centroids, angles, rows, bundle))
    plain = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("qvec").cast("array<float>").alias("qvec"), F.lit(None).cast("float").alias("least"))

    def dealt(again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Each query once for each cell that it has to meet: the nearest cells; or, again, once for each bundle with cells that may matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, angles, rows, bundle = shared.value
            cells = np.array(sorted(angles), int)
            for batch in batches:
                column, take, to = batch.column("qvec"), [], []
                least = batch.column("least").to_pylist()
                for i, query in enumerate(column.to_pylist()):
                    q = units(np.array([query or []], float))
                    if again:
                        bound = upper_bounds(q, centroids, angles)[0]
                        go = sorted({bundle[int(c)] for c in cells if least[i] is None or bound[int(c)] >= least[i] - SLACK})
                    else:
                        fits = q.shape[1] == centroids.shape[1]
                        near = np.where(cells == ODD, 0.0, centroids[np.maximum(cells, 0)] @ q[0]) if fits and len(centroids) else np.zeros(len(cells))
                        order = cells[np.lexsort((cells, -near))]
                        held = np.cumsum([rows[int(c)] for c in order])
                        go = order[: int(np.searchsorted(held, k)) + 1 if probes is None else probes].tolist()
                    take += [i] * len(go)
                    to += go
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("query_id", "qvec", "least")), pa.array(to, pa.int32())], ["query_id", "qvec", "least", "bundle"])

        return run

    schema = "query_id string, qvec array<float>, least float, bundle int"
    found = _top(_blocks(index, namespace, plain.mapInArrow(dealt(False), schema), k, rows, alone), k)
    if probes is not None:
        return found
    least = kept(found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")))  # a number for each query
    again = plain.drop("least").join(least, "query_id", "left").select("query_id", "qvec", "least")
    return _top(_blocks(index, namespace, again.mapInArrow(dealt(True), schema), k, rows, bundle), k)
