"""Bringing tables of different shapes into the unified `messages, source` schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.chat import (
    ChatOptions,
    alpaca_messages,
    qa_messages,
    sharegpt_messages,
    system_only_messages,
)
from lexloom.schemas import ALPACA_SOURCE, MESSAGES_TYPE, NULL_TEXT, QA_SOURCE, SHAREGPT_SOURCE, UNKNOWN_SOURCE

MessageBuilder = Callable[[DataFrame, ChatOptions], Column]

_BUILDERS: dict[str, MessageBuilder] = {}


def source_transform(name: str) -> Callable[[MessageBuilder], Callable[..., DataFrame]]:
    """Register how rows of a source become messages.

    The decorated function returns the `messages` column for a table of that source. The name it is bound to
    afterwards turns a table into the unified schema, with `source` filled in.
    """

    def register(builder: MessageBuilder) -> Callable[..., DataFrame]:
        _BUILDERS[name] = builder

        @wraps(builder)
        def transform(
            df: DataFrame, options: ChatOptions = ChatOptions(), keep: Sequence[str] = ()
        ) -> DataFrame:
            messages = builder(df, options).cast(MESSAGES_TYPE)
            return df.select(*keep, messages.alias("messages"), F.lit(name).alias("source"))

        return transform

    return register


def registered_sources() -> tuple[str, ...]:
    return tuple(_BUILDERS)


@source_transform(ALPACA_SOURCE)
def chat_from_alpaca(df: DataFrame, options: ChatOptions) -> Column:
    """Instruction and output as system, user and assistant message."""
    return alpaca_messages(df, options)


@source_transform(SHAREGPT_SOURCE)
def chat_from_sharegpt(df: DataFrame, options: ChatOptions) -> Column:
    """A system message followed by the conversation's turns."""
    return sharegpt_messages(df, options)


@source_transform(QA_SOURCE)
def chat_from_qa(df: DataFrame, options: ChatOptions) -> Column:
    """Input and output as system, user and assistant message."""
    return qa_messages(df, options)


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))


def pad_union(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of different columns one after the other; what a table lacks is null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)


def unify_by_source(
    df: DataFrame,
    options: ChatOptions = ChatOptions(turn_null_text=None),
    unknown: str = "system_only",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Unify a mixed table row by row, by the transform its `source` is registered with.

    Rows of other sources get the system message alone (`system_only`), or are read as question and answer
    (`qa`). One scan, no shuffle: all transforms are branches of one expression.
    """
    if unknown not in ("system_only", "qa"):
        raise ValueError(f"unknown must be system_only or qa, not {unknown!r}")
    if "source" in df.columns:
        source = F.coalesce(F.col("source").cast("string"), F.lit(NULL_TEXT))
    else:
        source = F.lit(UNKNOWN_SOURCE)
    messages = qa_messages(df, options) if unknown == "qa" else system_only_messages(options)
    for name, builder in _BUILDERS.items():
        messages = F.when(source == name, builder(df, options).cast(MESSAGES_TYPE)).otherwise(messages)
    if unknown == "system_only":
        source = F.when(source == "", UNKNOWN_SOURCE).otherwise(source)
    return df.select(*keep, messages.alias("messages"), source.alias("source"))


def unify_tables(
    tables: Sequence[tuple[str, DataFrame]],
    order: Sequence[str],
    options: ChatOptions = ChatOptions(),
) -> DataFrame:
    """Unify one table per source and put them one after the other.

    The result has `source_order` and the tables' common order columns in front, because rows of a Spark
    table have no place of their own. A source without a transform is read as question and answer.
    """

    def unified(position: int, name: str, df: DataFrame) -> DataFrame:
        builder = _BUILDERS.get(name, qa_messages)
        messages = builder(df, options).cast(MESSAGES_TYPE)
        return df.select(
            F.lit(position).alias("source_order"), *order, messages.alias("messages"), F.lit(name).alias("source")
        )

    return reduce(DataFrame.unionByName, [unified(i, name, df) for i, (name, df) in enumerate(tables)])


def explode_messages(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Unified rows in long form: one row per message, numbered from 0 as `pos`."""
    exploded = df.select(*keep, "source", F.posexplode("messages").alias("pos", "message"))
    return exploded.select(*keep, "pos", "message.role", "message.content", "source")
