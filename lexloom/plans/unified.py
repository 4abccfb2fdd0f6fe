"""Building one chat corpus from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lexloom.functions.chat import ChatOptions
from lexloom.operators.unify import pad_union, tag_source, unify_by_source, unify_tables
from lexloom.sources.corpus import SourceSpec, read_corpus


def _read(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    df = read_corpus(spark, spec.path, split=spec.split, fmt=spec.fmt)
    return df.withColumnsRenamed(spec.order)


def unify_sources(
    spark: SparkSession,
    specs: Sequence[SourceSpec],
    order: Sequence[str] = (),
    options: ChatOptions = ChatOptions(),
) -> DataFrame:
    """Read the sources and put their unified rows one after the other."""
    return unify_tables([(spec.name, _read(spark, spec)) for spec in specs], order, options)


def unify_lazily(
    tables: Sequence[tuple[str, DataFrame]],
    keep: Sequence[str] = (),
    options: ChatOptions = ChatOptions(turn_null_text=None),
) -> DataFrame:
    """Concatenate the tables as they are, tagged with their source, and transform row by row on access."""
    return unify_by_source(pad_union([tag_source(df, name) for name, df in tables]), options, keep=keep)
