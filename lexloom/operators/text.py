"""Operators that reduce a table to its keys and one `text` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import join_values, message_lines, render_messages, stringify, text_or_empty
from lexloom.schemas import DEFAULT_TEXT_COLUMNS

MESSAGE_COLUMNS = ("messages", "conversations")


def _all_values(df: DataFrame, columns: Sequence[str]) -> Column:
    return join_values([stringify(F.col(name), df.schema[name].dataType) for name in columns], " ")


def extract_text(df: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The text of every row: its `text`, else its `messages`, else all values joined by a space.

    The branch follows from the columns of the table, not from their values: a null `text` is empty text.
    `columns` narrows the table first, for example to leave out added order columns.
    """
    names = list(df.columns if columns is None else columns)
    if "text" in names:
        text = text_or_empty(F.col("text"), df.schema["text"].dataType)
    elif "messages" in names:
        text = message_lines(F.col("messages"), df.schema["messages"].dataType)
    else:
        text = _all_values(df, names)
    return df.select(*keep, text.alias("text"))


def extract_text_columns(
    df: DataFrame,
    text_columns: Sequence[str] = DEFAULT_TEXT_COLUMNS,
    keep: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The preferred text columns that exist, one below the other; if none exists, all values joined by a space."""
    names = list(df.columns if columns is None else columns)
    values = [
        (render_messages if name in MESSAGE_COLUMNS else stringify)(F.col(name), df.schema[name].dataType)
        for name in text_columns
        if name in names
    ]
    text = join_values(values, "\n") if values else _all_values(df, names)
    return df.select(*keep, text.alias("text"))
