"""Reports on how a corpus uses a vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.operators.order import head_rows
from lexloom.operators.text import extract_text_columns
from lexloom.operators.tokens import count_corpus, first_tokens, rare_tokens, top_tokens, usage_summary
from lexloom.operators.vocab import unused_tokens, with_token_text
from lexloom.plans.eviction import materialized_counts
from lexloom.schemas import (
    DEFAULT_REPORT_ROWS,
    DEFAULT_TEXT_COLUMNS,
    DEFAULT_TOP_K,
    REPORT_LINE,
    WORD_PATTERN,
)


def usage_report(counts: DataFrame, vocab: DataFrame, n: int = DEFAULT_REPORT_ROWS) -> DataFrame:
    """Unused and rare tokens as rows `(section, rank, token_id, token, value)`.

    `unused_count` holds the number of unused ids, `unused` the first n of them, `low_frequency` the n rarest
    used ones with their count as value; `reassign_unused` and `reassign_low_frequency` list both as candidates for new
    tokens. Pass counts that have been materialized.
    """
    unused = unused_tokens(vocab, counts)
    total = unused.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("unused_count").alias("section"),
        F.lit(0).alias("rank"),
        F.lit(None).cast("int").alias("token_id"),
        F.lit(None).cast("string").alias("token"),
        "value",
    )
    first_unused = first_tokens(unused, n).select(
        "rank", "token_id", "token", F.lit(0).cast("bigint").alias("value")
    )
    rare = with_token_text(rare_tokens(counts, n), vocab).select(
        "rank", "token_id", "token", F.col("cnt").alias("value")
    )

    def sections(rows: DataFrame, *names: str) -> DataFrame:
        section = F.explode(F.array(*[F.lit(name) for name in names])).alias("section")
        return rows.select(section, "rank", "token_id", "token", "value")

    return (
        total.unionByName(sections(first_unused, "unused", "reassign_unused"))
        .unionByName(sections(rare, "low_frequency", "reassign_low_frequency"))
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The low-frequency section as text lines with zero-padded ranks."""
    line = F.format_string(REPORT_LINE, F.col("rank"), F.col("token_id"), F.col("token"), F.col("value"))
    return report.where("section = 'low_frequency'").select("rank", line.alias("line"))


def report_usage(
    corpus: DataFrame,
    vocab: DataFrame,
    order: Sequence[str],
    limit: int | None = None,
    n: int = DEFAULT_REPORT_ROWS,
    unk_id: int | None = None,
    columns: Sequence[str] | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """The usage report of a corpus, or of its first `limit` rows."""
    rows = head_rows(corpus, order, limit)
    counts = materialized_counts(rows, vocab, order, unk_id=unk_id, columns=columns, pattern=pattern)
    return usage_report(counts, vocab, n)


def _setting(value: object) -> Column:
    """A setting with a type that every format can write: bigint, double, boolean, string or an array of strings."""
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value).cast("string") if value is None else F.lit(value)


def usage_document(
    counts: DataFrame, vocab: DataFrame, config: dict[str, object], k: int = DEFAULT_TOP_K
) -> DataFrame:
    """One row: the settings, the totals and the k most frequent tokens. Pass counts that have been materialized."""
    settings = F.struct(*[_setting(value).alias(name) for name, value in config.items()])
    top = with_token_text(top_tokens(counts, k), vocab)
    entry = F.struct("rank", "token_id", "token", F.col("cnt").alias("count")).alias("entry")
    no_total = F.lit(None).cast("bigint")
    no_entry = F.lit(None).cast("struct<rank:int,token_id:int,token:string,count:bigint>")
    parts = usage_summary(counts).withColumn("entry", no_entry).unionByName(
        top.select(no_total.alias("unique_token_count"), no_total.alias("total_token_count"), entry)
    )
    # k + 1 rows come together here.
    document = parts.agg(
        F.max("unique_token_count").alias("unique_token_count"),
        F.max("total_token_count").alias("total_token_count"),
        F.sort_array(F.collect_list("entry")).alias("entries"),
    )
    return document.select(
        settings.alias("config"),
        F.struct("unique_token_count", "total_token_count").alias("summary"),
        F.transform(
            "entries",
            lambda e: F.struct(
                e.getField("token_id").alias("token_id"),
                e.getField("token").alias("token"),
                e.getField("count").alias("count"),
            ),
        ).alias("top_tokens"),
    )


def summarize_usage(
    corpus: DataFrame,
    vocab: DataFrame,
    order: Sequence[str],
    text_columns: Sequence[str] = DEFAULT_TEXT_COLUMNS,
    limit: int | None = None,
    k: int = DEFAULT_TOP_K,
    unk_id: int | None = None,
    config: dict[str, object] | None = None,
    columns: Sequence[str] | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """The usage document of a corpus; its settings repeat the arguments, preceded by `config`."""
    rows = extract_text_columns(head_rows(corpus, order, limit), text_columns, keep=order, columns=columns)
    counts = materialize(count_corpus(rows, vocab, order, unk_id=unk_id, pattern=pattern))
    settings = {
        **(config or {}),
        "text_columns": list(text_columns),
        "sample_limit": limit,
        "top_k": k,
    }
    document = usage_document(counts, vocab, settings, k)
    # A missing limit has the type of a given one.
    return document.withColumn("config", F.col("config").withField("sample_limit", F.col("config.sample_limit").cast("bigint")))
