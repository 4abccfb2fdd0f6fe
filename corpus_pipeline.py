"""A training corpus from `documents`: language, near-duplicates, secrets, mixture, tokens. Counted as part of `lexloom.llm`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.llm import bpe, language, mixing, secrets, simhash

RANK_FILE = "byte_bpe_50k.tiktoken"

# SQL cannot express naive Bayes, fingerprints and encodings; `tests/llm` tests the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group with fingerprints at most two bits apart."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced in their texts."""
    return secrets.redact(docs, secrets.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of ids and decoded bytes."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path(RANK_FILE))
    ids = bpe.encode(F.col("text"), ranks, public_tokenizers.PATTERN)
    encoded = docs.select("doc_id", "source", "lang", bpe.digest(ids, ranks, public_tokenizers.PATTERN).alias("d"))
    return encoded.select("doc_id", "source", "lang", "d.*")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
