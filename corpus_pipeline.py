"""A corpus pipeline over ``documents``: filters, near duplicates, mixing and tokens.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe_words, crf_lines, mixing, simhash, toxicity
from leadloom.llm.common import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the toxicity threshold; learnt from the labelled rows of ``docs``."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are content by at least half."""
    return crf_lines.kept_rows(docs, crf_lines.learn(docs, table(spark, sf_dir, "labels")))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest id."""
    return simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows, once each, up to each leaf's budget."""
    return mixing.selected(docs, epochs=1).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again; digests of both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_words.digests(bpe_words.round_trip(
        docs, path, public_tokenizers.PATTERN))


STAGES = [("toxicity", toxicity_stage), ("quality rules", quality_stage),
          ("near duplicates", duplicates_stage), ("mixing", mixing_stage),
          ("tokens", tokens_stage)]

#: No SQL: models, XXH64 and byte pairs are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
