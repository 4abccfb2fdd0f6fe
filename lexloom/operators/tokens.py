"""From text to token ids and their counts."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.places import Places, measured_places, places_by_type
from lexloom.operators.lookup import attach
from lexloom.operators.order import _require_order
from lexloom.schemas import DEFAULT_REPORT_ROWS, DEFAULT_TOP_K, UNBOUNDED_LENGTH, WORD_PATTERN

# A vocabulary is sent to every executor only below this size, measured before each use.
BROADCAST_BYTES = 64 << 20

# No array of words is longer, so a greater limit is none.
MAX_WORDS = (1 << 31) - 1


def effective_max_length(model_max: Column, position_max: Column | None = None) -> Column:
    """The tokenizer's limit, or the model's number of positions where the former is practically unbounded."""
    if position_max is None:
        return model_max
    return F.when(model_max > UNBOUNDED_LENGTH, F.coalesce(position_max, model_max)).otherwise(model_max)


def split_words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pretokenize(
    df: DataFrame,
    order: Sequence[str],
    text: str = "text",
    max_length: int | Column | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """One row per word of a text, numbered from 0 as `pos`, at most `max_length` per text."""
    words = split_words(F.col(text), pattern)
    if max_length is not None:
        length = max_length if isinstance(max_length, Column) else F.lit(Decimal(max_length))
        words = F.slice(words, F.lit(1), F.least(length, F.lit(MAX_WORDS)).cast("int"))
    return df.select(*order, F.posexplode(words).alias("pos", "word"))


def _word_ids(vocab: DataFrame) -> DataFrame:
    """One id per token text, the lowest, so that the lookup never multiplies words."""
    return (
        vocab.where(F.col("token").isNotNull())
        .groupBy(F.col("token").alias("word"))
        .agg(F.min("token_id").alias("token_id"))
    )


def _with_ids(joined: DataFrame, unk_id: int | None) -> DataFrame:
    if unk_id is None:
        return joined.where(F.col("token_id").isNotNull())
    return joined.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id)))


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    order: Sequence[str],
    text: str = "text",
    max_length: int | Column | None = None,
    unk_id: int | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """Occurrences `(order…, pos, token_id)` of a corpus's words.

    Words outside the vocabulary become `unk_id`, or are left out if that is None. A vocabulary of checked size meets
    the words where they are. Of a larger one, only the entries of the most frequent words do, a bounded number that is
    counted first; other words meet the rest by a plain join. Runs jobs for the size and those words when called.
    """
    order = _require_order(df, order)
    words = pretokenize(df, order, text, max_length, pattern)
    joined = attach(words, _word_ids(vocab), ["word"], [*order, "pos"], BROADCAST_BYTES)
    return _with_ids(joined, unk_id).select(*order, "pos", "token_id")


def count_tokens(occurrences: DataFrame, order: Sequence[str]) -> DataFrame:
    """`(token_id, cnt, first_seen)` of occurrences; `first_seen` is the least struct of order columns and `pos`."""
    places = places_by_type(occurrences, _require_order(occurrences, order))
    counts = occurrences.groupBy("token_id").agg(
        F.count(F.lit(1)).alias("cnt"), places.least(places.row(), F.col("pos")).alias("_place")
    )
    return counts.select("token_id", "cnt", places.struct(F.col("_place")).alias("first_seen"))


def count_placed_words(words: DataFrame, places: Places) -> DataFrame:
    """`(word, _n, _place)` of rows `(_row, pos, word)`: how often, and where first."""
    return words.groupBy("word").agg(
        F.count(F.lit(1)).alias("_n"), places.least(F.col("_row"), F.col("pos")).alias("_place")
    )


def count_corpus(
    df: DataFrame,
    vocab: DataFrame,
    order: Sequence[str] | None,
    text: str = "text",
    max_length: int | Column | None = None,
    unk_id: int | None = None,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """`count_tokens` of `tokenize`, by counting words first; without `order` there is no `first_seen`.

    Each task sends one row per distinct word, so no word is too frequent for the shuffle; only distinct words
    meet the vocabulary, whatever its size, and by the word they are partitioned by already. With `order`, a job over
    the order columns may run when called.
    """
    if order is None:
        counted = pretokenize(df, [], text, max_length, pattern).groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
        tokens = _with_ids(counted.join(_word_ids(vocab), "word", "left"), unk_id)
        return tokens.groupBy("token_id").agg(F.sum("_n").alias("cnt"))
    order = _require_order(df, order)
    places = measured_places(df, order, max_length if isinstance(max_length, int) else None)
    length = [max_length.alias("_length")] if isinstance(max_length, Column) else []
    rows = df.select(places.row().alias("_row"), F.col(text).alias("_text"), *length)
    words = pretokenize(rows, ["_row"], "_text", F.col("_length") if length else max_length, pattern)
    counted = count_placed_words(words, places)
    tokens = _with_ids(counted.join(_word_ids(vocab), "word", "left"), unk_id)
    counts = tokens.groupBy("token_id").agg(F.sum("_n").alias("cnt"), F.min("_place").alias("_place"))
    return counts.select("token_id", "cnt", places.struct(F.col("_place")).alias("first_seen"))


def count_words(
    df: DataFrame, text: str = "text", pattern: str = WORD_PATTERN
) -> DataFrame:
    """`(word, cnt)` of a corpus."""
    return pretokenize(df, [], text, pattern=pattern).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def explode_token_ids(df: DataFrame, order: Sequence[str], column: str = "input_ids") -> DataFrame:
    """Occurrences of a table that holds one id list per row."""
    return df.select(*order, F.posexplode(column).alias("pos", "token_id"))


def usage_summary(counts: DataFrame) -> DataFrame:
    """How many ids occur, and how often in all."""
    return counts.agg(
        F.count(F.lit(1)).alias("unique_token_count"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_token_count"),
    )


def _ranked(kept: DataFrame, *sort: Column) -> DataFrame:
    """Ranks from 1 for the few rows a limit has left."""
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*sort)))


def first_tokens(tokens: DataFrame, n: int = DEFAULT_REPORT_ROWS) -> DataFrame:
    """The first n entries by id, with `rank`."""
    return _ranked(tokens.orderBy("token_id").limit(n), F.asc("token_id"))


def top_tokens(counts: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """The k most frequent ids, with `rank`; equal counts in order of first occurrence."""
    sort = [F.desc("cnt"), F.asc("first_seen")]
    return _ranked(counts.orderBy(*sort).limit(k), *sort)


def rare_tokens(counts: DataFrame, n: int = DEFAULT_REPORT_ROWS) -> DataFrame:
    """The n least frequent ids, with `rank`; of equal counts the last to appear comes first."""
    sort = [F.asc("cnt"), F.desc("first_seen")]
    return _ranked(counts.orderBy(*sort).limit(n), *sort)
