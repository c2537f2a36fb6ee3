"""The corpus pipeline: quality, shared lines, near-duplicates, mixing and tokens, one after the other.

Every stage but the last returns the columns of its input, further ones included,
whatever their names; the last one returns the ids and what the encoder makes of the texts.

Defined cases: null texts are scored like empty ones and stay null, have no line to lose,
are near-duplicates of nothing, have no token to draw, and are encoded as empty; a
null doc_id is smaller than any other and is not learned from; rows that repeat an id
and text stay or go together; rows that repeat an id with other texts are judged by
their own text, except that mixing draws an id and not a row; null sources and languages
are values of their own in mixing; without usable labels every document has the same score, and
all stay if it is at least the threshold; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import bpe, lines, minhash, mixing, quality
from cohortlab.scratch import fresh_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that later documents hold as well; n_chars follows the text."""
    return lines.with_char_counts(lines.drop_shared_lines(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities."""
    return mixing.keep_drawn(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", own_lines),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_documents),
    ("tokens", token_ids),
]

#: The classifier and the registers of near-duplicates cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
