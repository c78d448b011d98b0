"""The operators as registered queries: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import (
    byte_bpe, decontaminate, exponion, fill_middle, language_id, near_text, near_vectors, oracle, orc_tokens, page_text, piece_bpe, quality, sharding, toxicity,
)
from usagelens.llm.common import table


def op1_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_files(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_links(table(spark, sf_dir, "embeddings"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(table(spark, sf_dir, "documents"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.classify(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest_documents(table(spark, sf_dir, "documents"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digest_documents(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_orc_tokens, op2_language_id, op3_nn_descent, op4_order_minhash, op5_quality,
    op6_toxicity, op7_jump_sharding, op8_decontamination, op9_page_text, op10_byte_bpe,
    op11_exponion, op12_fill_middle, op13_piece_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can tell; tests/llm holds brute-force versions of the others."""
    return {
        op3_nn_descent.__name__: oracle.OP3, op7_jump_sharding.__name__: oracle.op7(), op8_decontamination.__name__: oracle.op8(),
        op11_exponion.__name__: oracle.op11(), op12_fill_middle.__name__: oracle.op12(),
    }
