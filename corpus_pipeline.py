"""documents, through five filters and mixers, to token files.

Toxic documents go; of each group of near-duplicates one document stays; documents that hold
benchmark passages go; sources are taken to their target weights, rows repeating as often as the
mix takes them; what is left is written as token-id files and reported from them. Each stage reads
what the one before wrote.

Defined cases, for every stage: rows with a null id or text pass as their stage's operator says (a null text has
no words, is never toxic by a word, and is a near-duplicate of no other id's; rows with a null id all stay in near_dedup);
empty and very long texts are read whole; rows that repeat id and text are judged alike, and near_dedup keeps one of
them; an empty table gives an empty one; further columns pass the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.common import stored, table
from memloom.llm.decontam import without_contaminated
from memloom.llm.mixing import mixed
from memloom.llm.pfor import read_token_files, write_token_files
from memloom.llm.queries import END_ID
from memloom.llm.near import one_of_each
from memloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't predicted toxic; without labels to learn from all stay. Ties at the threshold go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; texts without words are grouped where they are equal."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of which under a twentieth of the words lie in benchmark windows; an empty benchmark removes none."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, range-sorted by training position; ties by the row's key; null is a source of its own."""
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' report, one row for each document written: ids of a null or empty text are the end id alone."""
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

#: A trained network, similarity joins and a tokenizer are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
