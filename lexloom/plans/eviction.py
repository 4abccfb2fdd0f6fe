"""Selecting the vocabulary entries that give up their ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.functions.prunable import is_prunable
from lexloom.operators.order import number_rows
from lexloom.operators.text import extract_text
from lexloom.operators.tokens import count_corpus
from lexloom.operators.vocab import prunable
from lexloom.schemas import DEFAULT_EVICTION_RATIO, WORD_PATTERN


def _check_ratio(ratio: float) -> None:
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("the eviction ratio must be between 0.0 and 1.0")


def _quota(candidates: Column, ratio: float) -> Column:
    """At least one entry; computed in double precision, as a decimal literal would round differently."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(candidates * F.lit(float(ratio))))


def select_evicted(vocab: DataFrame, counts: DataFrame, ratio: float = DEFAULT_EVICTION_RATIO) -> DataFrame:
    """The evicted entries `(token_id, token, cnt)`, by id.

    One ranking fills the quota: unused entries by id, then used ones from the rarest on, of equal counts the
    last to appear first. Runs the job that ranks the candidates when called.
    """
    _check_ratio(ratio)
    entries = prunable(vocab).select("token_id", "token")
    candidates = entries.join(counts, "token_id", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))
    ranked = number_rows(
        candidates,
        F.asc("cnt"),
        F.when(F.col("cnt") == 0, F.col("token_id")).asc(),
        F.desc("first_seen"),
        name="_rank",
        total="_candidates",
    )
    evicted = ranked.where(F.col("_rank") < _quota(F.col("_candidates"), ratio))
    return evicted.select("token_id", "token", "cnt").orderBy("token_id")


def evict(
    corpus: DataFrame,
    vocab: DataFrame,
    order: Sequence[str],
    ratio: float = DEFAULT_EVICTION_RATIO,
    max_length: int | Column | None = None,
    unk_id: int | None = None,
    columns: Sequence[str] | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """From a corpus and a vocabulary to the evicted entries `(token_id, token)`, by id."""
    _check_ratio(ratio)
    rows = extract_text(corpus, keep=order, columns=columns)
    counts = count_corpus(rows, vocab, order, max_length=max_length, unk_id=unk_id, pattern=pattern)
    return select_evicted(vocab, counts, ratio).select("token_id", "token")


def eviction_stats(
    corpus: DataFrame, vocab: DataFrame, counts: DataFrame, ratio: float = DEFAULT_EVICTION_RATIO
) -> DataFrame:
    """The numbers behind an eviction, as `(metric, value)` rows. Pass counts that have been materialized."""
    _check_ratio(ratio)
    marked = vocab.select("token_id", is_prunable(F.col("token"), F.col("is_special")).alias("prunable")).join(
        counts.select("token_id", "cnt"), "token_id", "left"
    )
    unused = F.col("cnt").isNull()
    sizes = marked.agg(
        F.count(F.lit(1)).alias("vocab_tokens"),
        F.count_if("prunable").alias("prunable_tokens"),
        F.count_if(unused).alias("unused_tokens"),
        F.count_if(unused & F.col("prunable")).alias("unused_prunable_tokens"),
    )
    sizes = sizes.withColumn("quota", _quota(F.col("prunable_tokens"), ratio))
    sizes = sizes.withColumn("selected_unused", F.least("unused_prunable_tokens", "quota"))
    sizes = sizes.withColumn("selected_total", F.least("prunable_tokens", "quota"))
    sizes = sizes.withColumn("selected_rare", F.col("selected_total") - F.col("selected_unused"))
    corpus_rows = corpus.agg(F.count(F.lit(1)).alias("value")).select(F.lit("corpus_rows").alias("metric"), "value")
    used = counts.agg(F.count(F.lit(1)).alias("value")).select(F.lit("used_tokens").alias("metric"), "value")
    return (
        sizes.unpivot([], sizes.columns, "metric", "value").unionByName(corpus_rows).unionByName(used)
    )


def materialized_counts(
    corpus: DataFrame,
    vocab: DataFrame,
    order: Sequence[str],
    max_length: int | Column | None = None,
    unk_id: int | None = None,
    columns: Sequence[str] | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """Counts of a corpus, written down once for reports that read them several times."""
    rows = extract_text(corpus, keep=order, columns=columns)
    return materialize(count_corpus(rows, vocab, order, max_length=max_length, unk_id=unk_id, pattern=pattern))
