"""Line cleanup on text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import CONTENT_LINE, split_lines, strip


def explode_lines(df: DataFrame, column: str, keep: Sequence[str] = (), name: str = "line") -> DataFrame:
    """One row per line of a text column, numbered from 0 as `line_no`."""
    return df.select(*keep, F.posexplode(split_lines(F.col(column))).alias("line_no", name))


def clean_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Trim lines, then drop the blank ones and `#` comments."""
    return df.where(F.col(column).rlike(CONTENT_LINE)).withColumn(column, strip(F.col(column)))
