"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import (archives, bpe_words, crf_lines, lattice, mixing, ordinal, ranked, repair,
                          simhash, token_counts, top_k, toxicity, whitening)
from leadloom.llm.common import table


def op1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.digests(table(spark, sf_dir, "pages"))


def op2_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_lines.judged(docs, crf_lines.learn(docs, table(spark, sf_dir, "labels")))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.classes(table(spark, sf_dir, "documents")))


def op5_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.graded(docs, ordinal.learn(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op8_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_words.digests(bpe_words.round_trip(
        table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN)


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_archives, op2_crf_lines, op3_top_k, op4_simhash, op5_ordinal, op6_toxicity, op7_mixing,
    op8_bpe_words, op9_token_counts, op10_repair, op11_lattice, op12_whitening,
    op13_ranked_search, pipeline)}
SQL = {"op1_archives": archives.SQL, "op3_top_k": top_k.SQL, "op7_mixing": mixing.sql(),
       "op13_ranked_search": ranked.SQL}
