"""Column expressions that turn row values into text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.schemas import NULL_TEXT

NESTED = (T.ArrayType, T.StructType, T.MapType)

# Every whitespace character; all of them lie below this bound. SQL `trim` on its own takes off spaces only.
WHITESPACE = "".join(char for char in map(chr, range(0x3001)) if char.isspace())
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
CONTENT_LINE = r"(?U)^[\s\x1c-\x1f]*[^\s\x1c-\x1f#]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(col: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def split_lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def stringify(col: Column, dtype: T.DataType, null_text: str | None = NULL_TEXT) -> Column:
    """Any value as text. Nested values become JSON; null becomes `null_text`, or stays null if that is None."""
    if isinstance(dtype, NESTED):
        text = F.to_json(col)
    elif isinstance(dtype, T.BooleanType):
        text = F.when(col, "True").when(~col, "False")
    else:
        text = col.cast("string")
    return text if null_text is None else F.coalesce(text, F.lit(null_text))


def text_or_empty(col: Column, dtype: T.DataType) -> Column:
    """Text of a value, empty for null and for the values that count as nothing (zero, false)."""
    if isinstance(dtype, T.NumericType):
        col = F.nullif(col, F.lit(0).cast(dtype))
    elif isinstance(dtype, T.BooleanType):
        col = F.nullif(col, F.lit(False))
    return stringify(col, dtype, null_text="")


def field_text(
    item: Column, struct: T.StructType, name: str, missing: str, null_text: str | None = NULL_TEXT
) -> Column:
    """A struct field as text; `missing` if the struct type has no such field."""
    if name not in struct.names:
        return F.lit(missing)
    return stringify(item.getField(name), struct[name].dataType, null_text)


def _first_filled(item: Column, struct: T.StructType, names: tuple[str, ...], default: str) -> Column:
    filled = [
        F.nullif(text_or_empty(item.getField(name), struct[name].dataType), F.lit(""))
        for name in names
        if name in struct.names
    ]
    return F.coalesce(*filled, F.lit(default))


def message_lines(messages: Column, dtype: T.DataType) -> Column:
    """`role: content` lines. A missing role field reads `user`, a missing content field is empty, nulls print."""
    if not isinstance(dtype, T.ArrayType) or not isinstance(dtype.elementType, T.StructType):
        raise TypeError(f"messages must be an array of structs, not {dtype.simpleString()}")
    struct = dtype.elementType

    def line(message: Column) -> Column:
        role = field_text(message, struct, "role", "user")
        content = field_text(message, struct, "content", "")
        return F.concat(role, F.lit(": "), content)

    present = F.filter(messages, lambda message: message.isNotNull())
    return F.coalesce(F.array_join(F.transform(present, line), "\n"), F.lit(""))


def render_messages(value: Column, dtype: T.DataType) -> Column:
    """Messages or turns of either key style as text; empty roles and contents fall through to the other key."""
    if not isinstance(dtype, T.ArrayType):
        return stringify(value, dtype)
    element = dtype.elementType
    if not isinstance(element, T.StructType):
        lines = F.transform(value, lambda item: stringify(item, element))
    else:

        def line(item: Column) -> Column:
            role = _first_filled(item, element, ("role", "from"), "unknown")
            content = _first_filled(item, element, ("content", "value"), "")
            return F.when(item.isNull(), NULL_TEXT).otherwise(F.concat(role, F.lit(": "), content))

        lines = F.transform(value, line)
    return F.coalesce(F.array_join(lines, "\n"), F.lit(NULL_TEXT))


def join_values(values: list[Column], separator: str) -> Column:
    """Values that are never null, joined."""
    if not values:
        return F.lit("")
    return reduce(lambda left, right: F.concat(left, F.lit(separator), right), values)
