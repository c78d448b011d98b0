"""A training-data pipeline over documents: quality, language, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents. Between stages the rows
are written as Parquet to the shared folder and read again.

Cases: rows without text or letters go at the language stage at the latest; rows
with a null doc_id pass as documents of their own; rows equal in doc_id and text
are one after the third stage, and of near-duplicates the smallest doc_id stays,
so no tie is left; very long texts are read whole by every stage; an empty table
stays empty; further columns of documents are kept, whatever they are called, and
n_chars may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import byte_bpe, decontaminate, language_id, near_text, quality
from usagelens.llm.common import discard, free_name, fresh_path, table

#: No stage but the last can be told in SQL at whole size; tests hold brute-force versions.
ORACLE_SQL = None

#: A language is taken as known from this score on, and up to this rarity: texts of scripts or languages that none
#: was learned for, and strings of random letters, are several times rarer in every learned language than its own.
LEAST_LANGUAGE_SCORE = 0.5
MOST_RARITY = 4.0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    model = quality.fit(docs, quality.may_learn(table(spark, sf_dir, "labels")))
    score = free_name("quality", docs.columns)
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(_columns(docs))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the model knows; texts without a letter have none, nor have texts that are far from every language."""
    model = language_id.fit(language_id.training_rows(docs))
    lang, score, rarity = (free_name(n, docs.columns) for n in ("language", "language_score", "language_rarity"))
    told = language_id.predict(docs, model, (lang, score, rarity))
    known = (F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE) & (F.col(rarity) <= MOST_RARITY)
    return told.where(known).select(_columns(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    return near_text.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; n_chars counts what is left."""
    left = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    left = left.where(F.length(F.trim("text")) > 0)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return left.select(_columns(docs))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text back."""
    told = byte_bpe.encode_documents(docs, keep_text=True)
    same = (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip")
    return told.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("tokens", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage wrote goes when the next has been written; the last is read by the result."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = path, fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]
