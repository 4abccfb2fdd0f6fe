"""Column expressions that build the unified `messages` column from the three source shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import field_text, stringify
from lexloom.schemas import MESSAGES_TYPE, NULL_TEXT, SYSTEM_PROMPT


@dataclass(frozen=True)
class ChatOptions:
    """How messages are built.

    `null_text` stands for a null question, instruction or answer, `turn_null_text` for a null turn value;
    None keeps the null.
    """

    system_prompt: str = SYSTEM_PROMPT
    null_text: str | None = NULL_TEXT
    turn_null_text: str | None = NULL_TEXT


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _system(options: ChatOptions) -> Column:
    return _message(F.lit("system"), F.lit(options.system_prompt))


def _field(df: DataFrame, name: str, null_text: str | None) -> Column:
    if name not in df.columns:
        return F.lit("")
    return stringify(F.col(name), df.schema[name].dataType, null_text)


def _exchange(df: DataFrame, question: str, answer: str, options: ChatOptions) -> Column:
    messages = F.array(
        _system(options),
        _message(F.lit("user"), _field(df, question, options.null_text)),
        _message(F.lit("assistant"), _field(df, answer, options.null_text)),
    )
    return messages.cast(MESSAGES_TYPE)


def system_only_messages(options: ChatOptions) -> Column:
    return F.array(_system(options)).cast(MESSAGES_TYPE)


def alpaca_messages(df: DataFrame, options: ChatOptions) -> Column:
    return _exchange(df, "instruction", "output", options)


def qa_messages(df: DataFrame, options: ChatOptions) -> Column:
    return _exchange(df, "input", "output", options)


def sharegpt_messages(df: DataFrame, options: ChatOptions) -> Column:
    """System message, then every turn; only `human` turns are the user's. Null turns are skipped."""
    system = system_only_messages(options)
    if "conversations" not in df.columns:
        return system
    dtype = df.schema["conversations"].dataType
    if not isinstance(dtype, T.ArrayType) or not isinstance(dtype.elementType, T.StructType):
        raise TypeError(f"conversations must be an array of structs, not {dtype.simpleString()}")
    struct = dtype.elementType

    def turn_message(turn: Column) -> Column:
        role = F.lit("assistant")
        if "from" in struct.names:
            role = F.when(turn.getField("from") == "human", "user").otherwise("assistant")
        return _message(role, field_text(turn, struct, "value", "", options.turn_null_text))

    turns = F.filter("conversations", lambda turn: turn.isNotNull())
    messages = F.transform(turns, turn_message).cast(MESSAGES_TYPE)
    return F.concat(system, F.coalesce(messages, F.array().cast(MESSAGES_TYPE)))
