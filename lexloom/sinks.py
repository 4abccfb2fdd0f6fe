"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

FORMATS = ("json", "parquet", "orc", "csv")


def write_result(
    df: DataFrame, path: str, fmt: str = "json", order: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a result; with `order` the files, read by name, follow each other in that order."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    ordered = df.orderBy(*order) if order else df
    writer = ordered.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
