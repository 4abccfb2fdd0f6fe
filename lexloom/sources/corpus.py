"""Reading corpora and vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.schemas import VOCAB_SCHEMA

FORMATS = ("parquet", "orc", "json", "csv", "text")


@dataclass(frozen=True)
class SourceSpec:
    """Where a source lies. `order` maps its columns to the common order columns of a unified corpus."""

    name: str
    path: str
    split: str | None = None
    fmt: str = "parquet"
    order: dict[str, str] = field(default_factory=dict)


def read_corpus(
    spark: SparkSession,
    path: str | list[str],
    split: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: object,
) -> DataFrame:
    """A table from files. Splits are the values of a `split` column, best a partition column, which the scan prunes.

    Without a schema, CSV columns are strings; nothing is inferred by reading the data twice.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if split is None:
        return df
    if "split" not in df.columns:
        raise ValueError(f"{path} has no split column, so split {split!r} cannot be chosen")
    return df.where(F.col("split") == split).drop("split")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A text file as rows `value`."""
    return read_corpus(spark, path, fmt="text")


def read_vocab(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """A vocabulary table `(token_id, token, is_special)`."""
    schema = VOCAB_SCHEMA if fmt in ("json", "csv") else None
    df = read_corpus(spark, path, fmt=fmt, schema=schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in VOCAB_SCHEMA])
