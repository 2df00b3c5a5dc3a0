"""The vector table: one truth as Parquet by namespace, and an index of unit vectors that is rebuilt from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.vectors import norm
from memloom.operators.drawers import keep_latest, without
from memloom.sources.buckets import BucketTable
from memloom.sources.shared import kept


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return keep_latest(vectors, new, ["namespace", "id"])


def delete(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    return without(vectors, gone, ["namespace", "id"])


def namespaces(vectors: DataFrame) -> DataFrame:
    return vectors.select("namespace").distinct()


def points(vectors: DataFrame, namespace: str, wanted: DataFrame | None = None) -> DataFrame:
    own = vectors.where(F.col("namespace") == namespace)
    return own.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else own


def unit_index(vectors: DataFrame) -> DataFrame:
    """(namespace, id, unit): vectors of length 1, zero vectors as they are."""
    size = norm(F.col("vec"))
    return vectors.select("namespace", "id", F.when(size > 0, F.transform("vec", lambda v: (v / size).cast("float"))).otherwise(F.col("vec")).alias("unit"))


def write_truth_then_index(vectors: DataFrame, truth: str, index: str) -> None:
    """Overwrites the namespaces that vectors has: the truth first, then the index, from what was written."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(truth)
    rebuild(vectors.sparkSession.read.parquet(truth).join(vectors.select("namespace").distinct(), "namespace", "left_semi"), index)


def rebuild(vectors: DataFrame, index: str) -> None:
    unit_index(vectors).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(index)


def sync(vectors: DataFrame, index: str, recreate: bool = False) -> DataFrame:
    """(namespace, failed) for every namespace of vectors, after its index is brought up to it: what vectors has is put in, or, with
    recreate, the namespace is written anew, so what the truth no longer has goes. A namespace that fails doesn't stop the others."""
    spark = vectors.sparkSession
    out = []
    for row in namespaces(vectors).collect():  # the namespaces, not their vectors
        own = points(vectors, row.namespace)
        try:
            if recreate:
                rebuild(own, index)
            else:
                fresh, there = unit_index(own), points(spark.read.parquet(index), row.namespace)
                both = there.join(fresh, "id", "left_anti").select("namespace", "id", "unit").unionByName(fresh)
                kept(both).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(index)
            out.append((row.namespace, False))
        except Exception as error:  # the caller sees which failed
            spark._jvm.org.slf4j.LoggerFactory.getLogger("memloom").warn(f"index of {row.namespace}: {error}")
            out.append((row.namespace, True))
    return spark.createDataFrame(out, "namespace string, failed boolean")


def index_table(spark: SparkSession, path: str, buckets: int = 256) -> BucketTable:
    """An empty index of unit vectors by buckets, which `sync_by_digests` keeps."""
    return BucketTable.create(spark, path, spark.createDataFrame([], "namespace string, id string, unit array<float>").schema, ["namespace", "id"], buckets)


def sync_by_digests(vectors: DataFrame, index: BucketTable, batch: str, recreate: bool = False) -> DataFrame:
    """(namespace, put, gone): brings an index by buckets up to vectors, all namespaces at once, and says what was written of each. With
    recreate, what the truth no longer has goes. Both sides are summed up to a count and a digest for each bucket; only rows of
    buckets that differ are compared, and only buckets with changes are written, in one commit, so a sync fails or comes whole."""
    fresh = unit_index(vectors)

    def digests(rows: DataFrame, name: str) -> DataFrame:
        one = F.xxhash64("namespace", "id", "unit").cast("decimal(38,0)")
        return rows.groupBy(index.bucket().alias("bucket")).agg(F.struct(F.count("*").alias("n"), F.sum(one).alias("d")).alias(name))

    there = index.read()
    sides = digests(fresh, "a").join(digests(there, "b"), "bucket", "full_outer")
    differ = [r.bucket for r in sides.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect()]  # numbers of buckets
    own = lambda rows: rows.where(index.bucket().isin(differ))
    same = ["namespace", "id", "unit"]
    put = own(fresh).join(own(there), same, "left_anti").withColumn("gone", F.lit(False))
    gone = own(there).join(own(fresh), ["namespace", "id"], "left_anti").withColumn("gone", F.lit(True)) if recreate else put.limit(0)
    changes = kept(put.select(*same, "gone").unionByName(gone.select(*same, "gone")))

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return without(old, new, ["namespace", "id"]).unionByName(new.where(~F.col("gone")).select(*old.columns))

    index.change(batch, changes, change)
    return changes.groupBy("namespace").agg(F.count_if(~F.col("gone")).alias("put"), F.count_if("gone").alias("gone"))
