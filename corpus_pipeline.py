"""A training corpus from ``documents``: identify languages, drop near copies, drop benchmark leaks, mix sources, write tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sundew.llm import decontaminate, language, mixing, near_dups, token_files
from sundew.llm.common import read_table, shared_folder

#: Words whose ids a worker of the last stage keeps: its executors still hold what the stages before have left.
MOST_WORDS = 250_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language; trees are learned from the labelled documents that are not held out."""
    return language.keep_identified(docs, language.learned(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dups.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark item: five-word shingles, containment 0.8."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns each document's place and checksum, read back from them."""
    return token_files.write_and_read(docs, most=MOST_WORDS)


STAGES = [
    ("language", identify),
    ("near_duplicates", drop_copies),
    ("benchmark_leaks", drop_leaks),
    ("mixture", mix_sources),
    ("token_files", write_token_files),
]
#: The stages learn, sketch and draw, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    root = shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
