"""From documents to packed training sequences in five stages, each over all rows that the one before kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from siftline.llm.common import FOLDERS, cut, discard

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, and null texts, go."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return near_dedup.keep_first_of_groups(docs, SHINGLE)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing is left go."""
    return suffix_dedup.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and offsets."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


_LEFT: list[str] = []


def stage(work):
    """The stage, which first deletes what the stage before has left in the shared folder: its result is a table by now.

    The first stage deletes nothing, because the result of an earlier run may still be read.
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if work is not language:
            discard(_LEFT, docs)
        before = len(FOLDERS)
        result = work(spark, docs, sf_dir)
        _LEFT[:] = FOLDERS[before:]
        return result

    return run_stage


STAGES = [(name, stage(work)) for name, work in (("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", repeats), ("packing", sequences))]

#: SQL can express neither the language model nor the tokenizer; a test holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = cut(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
