"""Operators on a vocabulary `(token_id, token, is_special)` and the counts of its ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.prunable import is_prunable


def prunable(vocab: DataFrame) -> DataFrame:
    """The entries that may be given up."""
    return vocab.where(is_prunable(F.col("token"), F.col("is_special")))


def unused_tokens(vocab: DataFrame, counts: DataFrame, prunable_only: bool = False) -> DataFrame:
    """The entries that never occur."""
    entries = prunable(vocab) if prunable_only else vocab
    return entries.join(counts.select("token_id"), "token_id", "left_anti")


def used_tokens(vocab: DataFrame, counts: DataFrame, prunable_only: bool = False) -> DataFrame:
    """The counts of entries, only of those that may be given up if asked."""
    entries = prunable(vocab) if prunable_only else vocab
    return counts.join(entries.select("token_id"), "token_id", "left_semi")


def with_token_text(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add `token`; ids outside the vocabulary keep a null."""
    return df.join(vocab.select("token_id", "token"), "token_id", "left")


def label_vocab(vocab: DataFrame, evicted: DataFrame) -> DataFrame:
    """Add `status`: `evicted` or `kept`."""
    marks = evicted.select("token_id", F.lit("evicted").alias("_status"))
    labelled = vocab.join(marks, "token_id", "left")
    return labelled.withColumn("status", F.coalesce("_status", F.lit("kept"))).drop("_status")
