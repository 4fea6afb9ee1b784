"""A training-data pipeline over ``documents``: five stages, each one of the operators of
``presswork.llm``. A stage's rows are written and read again before the next one starts.

1. quality: documents that the weak-label classifier rejects go.
2. near_dedup: of each group of near copies the document of the smallest id stays.
3. decontaminate: documents with a benchmark passage go.
4. secrets: secrets in the texts give way to a mark.
5. tokens: byte-level BPE ids of every text and the round trip through them (one row a document).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import byte_bpe, decontaminate, minhash_dedup, quality, secret_scan
from presswork.llm.common import read_table, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"), mode="documents")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fit(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]

#: Neither a trained classifier nor near-duplicate components can be put in SQL; tests/llm holds each
#: stage against a plain version instead (quality: rows kept as they were, by the classifier's verdicts).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
