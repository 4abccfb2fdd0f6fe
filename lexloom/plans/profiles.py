"""Profiles of tables before use: splits, schema and one sample row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.checkpoints import materialize
from lexloom.functions.text import stringify
from lexloom.operators.order import number_rows
from lexloom.schemas import LOAD_FAILED, NO_COLUMNS, NO_SAMPLE, PROFILE_SCHEMA, SINGLE_SPLIT
from lexloom.sources.corpus import read_corpus

PARTS = ("splits", "schema", "sample")
LONG_SCHEMA = "name string, part string, pos int, line string"


def _quoted(text: Column) -> Column:
    """A string between quotes, with line breaks, tabs and backslashes escaped."""
    shown = text
    for character, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        shown = F.replace(shown, F.lit(character), F.lit(escape))
    single = F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), shown, F.lit('"'))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), double).otherwise(single)


def _shown(field: T.StructField) -> Column:
    """A column as a line of the sample; nested values are JSON."""
    column = F.col(f"`{field.name}`")
    value = _quoted(column) if isinstance(field.dataType, T.StringType) else stringify(column, field.dataType)
    return F.concat(F.lit(f"{field.name}: "), F.coalesce(value, F.lit("None")))


def _lines(one_row: DataFrame, name: str, part: str, lines: Column) -> DataFrame:
    """The lines of a table's part, from a row that holds them."""
    return one_row.select(F.lit(name).alias("name"), F.lit(part).alias("part"), F.posexplode(lines).alias("pos", "line"))


def _profile(name: str, df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A table's profile in long form, as a plan: its distinct splits numbered in sorted ranges, a one-row sort for its sample.

    Numbering the splits runs jobs when called.
    """
    fields = [field for field in df.schema.fields if field.name != "split"]
    schema = [f"{field.name}: {field.dataType.simpleString()}" for field in fields] or [NO_COLUMNS]
    by_split = "split" in df.columns
    rows = df.where(F.col("split").isNotNull()) if by_split else df
    sort = [*(["split"] if by_split else []), *order]
    first = (rows.orderBy(*sort) if sort else rows).limit(1)
    shown = F.array(*[_shown(field) for field in fields]) if fields else F.array(F.lit(NO_SAMPLE))
    sample = first.select(shown.alias("sample")).agg(F.first("sample").alias("sample"))
    if by_split:
        names = rows.select(F.col("split").cast("string").alias("line")).distinct()
        numbered = number_rows(names, F.asc("line"), name="pos")
        splits = numbered.select(F.lit(name).alias("name"), F.lit("splits").alias("part"), F.col("pos").cast("int").alias("pos"), "line")
    else:
        splits = _lines(sample, name, "splits", F.array(F.lit(SINGLE_SPLIT)))
    failed = F.array(F.lit(LOAD_FAILED))
    constant = F.array(*[F.lit(line) for line in schema])
    found = F.col("sample").isNotNull() | F.lit(not by_split)
    return splits.unionByName(_lines(sample, name, "schema", F.when(found, constant).otherwise(failed))).unionByName(
        _lines(sample, name, "sample", F.coalesce("sample", F.array(F.lit(LOAD_FAILED if by_split else NO_SAMPLE))))
    )


def _reason(error: Exception) -> str:
    lines = str(error).strip().splitlines()
    return f"{LOAD_FAILED}: {lines[0] if lines else type(error).__name__}"


def profile_lines(
    spark: SparkSession,
    tables: Mapping[str, str | DataFrame],
    fmt: str = "parquet",
    order: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Profiles in long form `(name, part, pos, line)`, written down by one job for all tables.

    A table that cannot be opened or read has an error as schema and sample and no splits. If reading fails, tables are
    read one by one to find which. `order` names the columns by which a table's first row is meant; without it, any
    row of its alphabetically first split is shown.
    """
    plans, failed = {}, []
    for name, table in tables.items():
        try:
            df = read_corpus(spark, table, fmt=fmt) if isinstance(table, str) else table
            plans[name] = _profile(name, df, (order or {}).get(name, ()))
        except Exception as error:
            failed.append((name, _reason(error)))
    try:
        readable = [materialize(reduce(DataFrame.unionByName, plans.values()))] if plans else []
    except Exception:
        readable = []
        for name, plan in plans.items():
            try:
                readable.append(materialize(plan))
            except Exception as error:
                failed.append((name, _reason(error)))
    broken = [(name, part, 0, reason) for name, reason in failed for part in PARTS[1:]]
    return reduce(DataFrame.unionByName, readable, spark.createDataFrame(broken, LONG_SCHEMA))


def profile_tables(
    spark: SparkSession,
    tables: Mapping[str, str | DataFrame],
    fmt: str = "parquet",
    order: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per table: its splits (null if it cannot be read), its columns and a row of its first split."""
    lines = profile_lines(spark, tables, fmt, order)
    found = lines.groupBy("name").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("pos", "line")))).alias(part) for part in PARTS]
    )
    shown = [F.col(part)["line"].alias(part) for part in PARTS[1:]]
    # A table with a column of splits but no value in it has no lines for them, as one that cannot be read.
    unread = F.exists(F.col("schema")["line"], lambda line: F.startswith(line, F.lit(f"{LOAD_FAILED}: ")))
    return found.select("name", F.when(~unread, F.col("splits")["line"]).alias("splits"), *shown).select(*PROFILE_SCHEMA.names)


def explode_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles in long form: `(name, part, pos, line)`."""
    parts = [profiles.select("name", F.lit(part).alias("part"), F.posexplode(part).alias("pos", "line")) for part in PARTS]
    return reduce(DataFrame.unionByName, parts)
