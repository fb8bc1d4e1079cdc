"""A training-data pipeline over ``documents``: five stages, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinlake.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece_codec
from skeinlake.llm.common import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learnt from them; rejected ones go."""
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common lines are deleted from the later document; documents with nothing left go."""
    return line_dedup.without_copied_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that of the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontaminate.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the SentencePiece ids of each text."""
    return sentencepiece_codec.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontaminate", benchmark),
    ("sentencepiece", tokens),
]
#: Language models and Viterbi segmentations are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of what the stages leave of ``documents``, each stage on all that the one before kept.

    Null texts and texts without letters go in the first stage; documents of which no line is left in the second; all
    but the smallest doc_id of each group in the third, repeated rows of one doc_id and text stay together; passages
    are cut in the fourth. An empty table gives none. Other columns, whatever their names, travel to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
