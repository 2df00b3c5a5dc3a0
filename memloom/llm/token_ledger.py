"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch is a set of events (op, source, lang, tokenizer, tokens, old_tokenizer, old_tokens):
insert adds a document and its tokens, delete takes them away, revise moves a document from its
old tokenizer and count to the new ones. A batch's events become one signed row for each group,
written below its batch id; they are added to the last totals, which become a new version; and a
commit names the batch and the version. Committing the id again changes nothing; a batch that was
lost before its commit is written anew. Reading totals reads the last version only: neither
documents nor earlier deltas are read again. Versions before the last two can be removed (`prune`).

Defined cases: null text counts no tokens; null source or language is a group of its own; repeated
rows of a document each count, as events do; what was never inserted and is deleted takes a group
below zero, which a later insert makes good; groups whose documents and tokens are back at zero are
left out; an unknown op is an error; an empty batch commits and changes nothing; other columns are
ignored. One writer at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.tokens import tokenizer

GROUP = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Characters of text that are tokenised at once, but for one longer text.
CHARS = 4_000_000


@lru_cache(2)
def _ranked(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str, other: str | None = None, pattern: str | None = None, other_when: str = "false") -> DataFrame:
    """docs' (doc_id, source, lang) with tokens, by the tokenizers file vocabulary, and other_tokens, by the
    tiktoken file other for rows where other_when holds, else null."""

    def counts(texts: list[str]) -> list[int]:
        out, start, chars = [], 0, 0
        for i, text in enumerate(texts):
            if chars and chars + len(text) > CHARS:
                out += tokenizer(vocabulary).encode(texts[start:i])[1].tolist()
                start, chars = i, 0
            chars += len(text)
        return out + tokenizer(vocabulary).encode(texts[start:])[1].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            second = [len(_ranked(other, pattern).encode_ordinary(t)) if w else None for t, w in zip(texts, batch.column("w").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(counts(texts), pa.int64()), pa.array(second, pa.int64())], ["doc_id", "source", "lang", "tokens", "other_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("t"), F.expr(other_when).alias("w"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long, other_tokens long")


def signed(events: DataFrame) -> DataFrame:
    """One signed row (DELTA) for each group that events change."""
    new, old = (F.struct(F.col(p + "tokenizer").alias("tokenizer"), F.lit(s).alias("n_docs"), (s * F.col(p + "tokens")).alias("n_tokens")) for p, s in (("", 1), ("old_", -1)))
    gone = F.struct(F.col("tokenizer"), F.lit(-1).alias("n_docs"), (-F.col("tokens")).alias("n_tokens"))
    moves = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new)).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    return summed(events.select("source", "lang", F.explode(moves).alias("m")).select("source", "lang", "m.*"))


def summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class Ledger:
    """Versions of totals, and the deltas that made them, below a shared folder; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch_id string, version long").parquet(f"{self.folder}/commits/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "batch_id string, version long")

    def committed(self, batch_id: str) -> bool:
        return not self._commits().where(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Writes the batch and commits it; False, and nothing done, if it was committed before."""
        if not batch_id.isalnum():
            raise ValueError("a batch id is letters and digits")
        if self.committed(batch_id):
            return False
        before, version = self.totals(), self.version() + 1
        signed(events).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch_id}")
        delta = self.spark.read.schema(DELTA).parquet(f"{self.folder}/deltas/{batch_id}")
        summed(before.unionByName(delta)).write.mode("overwrite").parquet(f"{self.folder}/totals/{version}")
        self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch_id}")
        return True

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        return self._commits().agg(F.max("version")).first()[0] or 0

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches: the last version."""
        version = self.version()
        return self.spark.read.schema(DELTA).parquet(f"{self.folder}/totals/{version}") if version else self.spark.createDataFrame([], DELTA)

    def recounted(self) -> DataFrame:
        """The totals from all committed deltas, to hold the maintained ones against."""
        parts = [self.spark.read.schema(DELTA).parquet(f"{self.folder}/deltas/{r.batch_id}") for r in self._commits().select("batch_id").distinct().collect()]  # the batches' names
        return summed(reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], DELTA)))

    def prune(self) -> None:
        """Removes the versions of totals that neither the last commit nor the one before made."""
        last = self.version()
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in system.listStatus(path) if system.exists(path) else ():
            name = status.getPath().getName()
            if name.isdigit() and int(name) < last - 1:
                system.delete(status.getPath(), True)
