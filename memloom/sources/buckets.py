"""Keyed tables that are changed bucket by bucket.

A table is a folder. Its rows lie in buckets by a hash of their key, and each commit is a small file that says, for every bucket, which
version's files hold it. A merge reads and rewrites only the buckets that its rows fall in, so its cost goes with the change. A commit
is a file that is made only if it isn't there, so of two writers one fails and nothing is half done; files of a commit that
never came are not read, and are written over by the next try.

Batches have ids, which commits remember: a batch that comes again changes nothing. Readers name a version or take the last, and see
the table as it was then, whatever is written meanwhile. The number of buckets is fixed when a table is made, which bounds a commit.

Defined cases: of rows that repeat a key the last by `order` counts, then the greatest; an empty batch is a commit without
changes; null keys are a key like any other; columns that a table doesn't have are left out, missing ones are null,
and values are cast to the table's types.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memloom.sources.shared import kept

#: Fixed value: the files of a commit at most, if it writes no more buckets than that.
MOST_FILES = 512


def put_in(old: DataFrame, new: DataFrame, keys: list[str], places: dict[str, Column], keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """What `drawers.keep_latest` gives, of an old table that has each key once, with columns for places, which keys determine. Rows of both
    sides are dealt by their places once, meet there by their keys, and stay there."""
    names = [c for c in old.columns if c not in keys]
    given = [*order, *(c for c in names if c in new.columns and c not in order)]
    both = old.select(*keys, F.struct(*names).alias("__old")).unionByName(new.select(*keys, F.struct(*given).alias("__new")), allowMissingColumns=True)
    dealt = both.withColumns(places).repartition(*places)
    met = dealt.groupBy(*places, *keys).agg(F.max("__old").alias("__old"), F.max("__new").alias("__new"))

    def value(c: str) -> Column:
        fresh = F.col("__new")[c] if c in given else F.lit(None).cast(old.schema[c].dataType)
        first, other, there = (F.col("__old")[c], fresh, "__old") if c in keep else (fresh, F.col("__old")[c], "__new")
        return F.when(F.col(there).isNotNull(), first).otherwise(other)

    return met.select(*(c if c in keys else value(c).alias(c) for c in old.columns), *places)


class BucketTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = json.loads(self._text(f"{self.path}/table.json"))
        self.keys, self.by, self.buckets, self.schema = head["keys"], head["by"], head["buckets"], StructType.fromJson(head["schema"])

    @staticmethod
    def create(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 256, by: list[str] | None = None) -> BucketTable:
        """An empty table; a folder that has one already is an error. Rows that agree in by, some of the keys, lie in one bucket."""
        head = {"keys": keys, "by": by or keys, "buckets": buckets, "schema": json.loads(schema.json())}
        _write_once(spark, f"{path.rstrip('/')}/table.json", json.dumps(head))
        return BucketTable(spark, path)

    def _text(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(path).collect())  # one small file

    def versions(self) -> list[int]:
        fs, folder = _file_system(self.spark, f"{self.path}/commits")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def commit_of(self, version: int) -> dict:
        return json.loads(self._text(f"{self.path}/commits/{version:012d}.json"))

    def _last(self) -> dict:
        found = self.versions()
        return self.commit_of(found[-1]) if found else {"version": 0, "batches": [], "held": {}}

    def bucket(self) -> object:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _read(self, held: dict[str, int], only: Iterable[int] | None = None) -> DataFrame:
        wanted = held if only is None else {str(b): held[str(b)] for b in only if str(b) in held}
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in wanted.items()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, by default the last; version 0 is the empty table."""
        commit = self._last() if version is None else self.commit_of(version) if version else {"held": {}}
        return self._read(commit["held"])

    def rewritten(self, version: int) -> DataFrame:
        """The rows, as of a version, of the buckets that its commit wrote."""
        commit = self.commit_of(version)
        return self._read(commit["held"], commit["rewritten"])

    def _commit(self, batch: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame] | None, keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> int:
        """Without change, rows are put in by their keys."""
        last = self._last()
        if batch in last["batches"]:
            return last["version"]
        rows = rows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in self.schema.fields if f.name in rows.columns})  # a bucket goes by a key as it is stored
        rows = kept(rows)  # read for its buckets and for its rows
        hit = sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())  # numbers of buckets
        version, held = last["version"] + 1, dict(last["held"])
        if hit:
            old, folder = self._read(held, hit), f"{self.path}/data/version={version}"
            # a bucket is written in parts by its keys, so that a task's share falls with the number of tasks, not of buckets; small ones are put together
            part = F.pmod(F.xxhash64(*self.keys, F.lit("part")), F.lit(max(1, MOST_FILES // len(hit))))
            if change is None:
                new = put_in(old, rows, self.keys, {"__bucket": self.bucket(), "__part": part}, keep, order).withColumnRenamed("__bucket", "bucket").drop("__part")
            else:
                new = change(old, rows).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("bucket", self.bucket()).repartition("bucket", part)
            new.write.mode("overwrite").partitionBy("bucket").parquet(folder)
            fs, place = _file_system(self.spark, folder)
            there = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(place) if s.getPath().getName().startswith("bucket=")}
            for b in hit:  # a bucket whose rows all went has no files
                if b in there:
                    held[str(b)] = version
                else:
                    held.pop(str(b), None)
        _write_once(self.spark, f"{self.path}/commits/{version:012d}.json", json.dumps({"version": version, "batches": [*last["batches"], batch], "rewritten": hit, "held": held}))
        return version

    def merge(self, batch: str, rows: DataFrame, keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> int:
        """Puts rows in by their keys; columns in keep stay as the table has them. Returns the version that has the batch, or the last
        one where it came before."""
        return self._commit(batch, rows, None, keep, order)

    def change(self, batch: str, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Puts how(rows of the buckets, rows) in place of the buckets that rows fall in; how keeps every row in its bucket."""
        return self._commit(batch, rows, how)

    def delete(self, batch: str, gone: DataFrame) -> int:
        """Takes out the rows with the keys of gone."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            return old.alias("o").join(new.select(*self.keys).distinct().alias("n"), same, "left_anti")

        return self._commit(batch, gone.select(*self.keys), change)

    def merge_stream(self, name: str, keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: merges each batch of a stream of that name once."""
        return lambda rows, number: self.merge(f"{name}-{number}", rows, keep, order) and None


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _write_once(spark: SparkSession, path: str, text: str) -> None:
    """Makes a small file; one that is there is an error."""
    fs, place = _file_system(spark, path)
    out = fs.create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
