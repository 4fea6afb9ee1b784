"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import (byte_bpe, chat_format, decontaminate, embedding_dedup, html_extract, language_id, lexical_search,
                           minhash_dedup, quality, run_detect, secret_scan, token_store, url_filter)
from presswork.llm.common import read_table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_forged(read_table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.render(chat_format.reconstruct(chat_format.events_of_turns(turns))))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.find(docs, secret_scan.fit(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(spark, token_store.write_tokens(read_table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"),
                                              read_table(spark, sf_dir, "benchmark"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_run_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_detect.report(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_format, op2_html_extract, op3_minhash_dedup, op4_secret_scan, op5_quality, op6_url_filter, op7_byte_bpe,
        op8_token_store, op9_decontaminate, op10_embedding_dedup, op11_run_detect, op12_lexical_search, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.DIGEST_SQL, "op9_decontaminate": decontaminate.REPORT_SQL,
            "op12_lexical_search": lexical_search.SEARCH_SQL}
