"""What several operators share: words, folds and the rank of rows in a hash."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(key: Column, folds: int = 5) -> Column:
    """The fold of a row by the CRC-32 of its key as text; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def quoted(name: str) -> str:
    """A column's name as an expression, also with a dot or a backtick in it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[quoted(name) for name in df.columns])


# Of an Arrow batch, so many rows at a time become Python objects, which keeps workers small.
SLICE_ROWS = 256


def slices(column: pa.Array) -> Iterator[list]:
    """The values of a column as Python objects, a few rows at a time."""
    for at in range(0, len(column), SLICE_ROWS):
        yield column.slice(at, SLICE_ROWS).to_pylist()


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, also where `use` reads it within lambdas of its own."""
    return F.element_at(F.transform(F.array(value), use), 1)
