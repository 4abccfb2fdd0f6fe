"""Bringing the values of a keyed table to many rows, whatever the keys' frequencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table goes to every executor below this size, measured before each use.
BROADCAST_BYTES = 16 << 20
_ROW_OVERHEAD_BYTES = 64

# So many of the most frequent keys of a larger table go to every executor as long as their values are small.
HOT_KEYS = 1_000


def table_bytes(table: DataFrame) -> int:
    """A bound of a table's size in memory, measured now."""
    width = F.lit(_ROW_OVERHEAD_BYTES)
    for field in table.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            width = width + F.lit(16)
    return table.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    limit: int = BROADCAST_BYTES,
    frequent: DataFrame | None = None,
) -> DataFrame:
    """Left join of `rows` with a written `table` that has one row per key; null keys find nothing.

    A table of checked size goes to the rows. Beyond that size, the most frequent keys (a bounded number) do, and
    only the other rows meet the table by key. Rows of frequent and of null keys are spread by a hash of
    `spread_by`, so that no task gets all of them. Rows need identifying values in `spread_by`. `frequent` holds the most
    frequent keys where they are known already; they must be few, as they go to every executor.
    """
    keys = list(keys)
    values = [name for name in table.columns if name not in keys]
    if table_bytes(table) <= limit:
        return rows.join(F.broadcast(table), keys, "left")
    if frequent is None:
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        frequent = counted.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).drop("_n")
    hot = table.join(F.broadcast(frequent), keys).select(*keys, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    # The slot of a row that meets the table here is its key's; any other row gets one of its own. It is no constant on
    # either side, as the optimizer would then join by the keys alone.
    no_key = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in keys])
    own = F.when(F.col("_hot").isNotNull() | no_key, F.xxhash64(*spread_by, F.lit("own")))
    marked = marked.withColumn("_slot", F.coalesce(own, F.xxhash64(*keys)))
    cold = table.select(*keys, F.struct(*values).alias("_cold"), F.xxhash64(*keys).alias("_slot"))
    joined = marked.join(cold, [*keys, "_slot"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *[F.col("_found")[name].alias(name) for name in values])
