"""Operators whose result depends on row order. Spark tables have none, so each takes its order columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.schemas import DEFAULT_SAMPLE_ROWS, DEFAULT_SEED

# monotonically_increasing_id keeps the row's place within its partition in the low bits.
_PLACE_BITS = 33

# Up to so many first rows, their keys come to the driver; for more, all keys are numbered where they are.
FEW_ROWS = 10_000

# Drawn rows are sent to every executor up to this number.
BROADCAST_ROWS = 100_000


def _require_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    names = [order] if isinstance(order, str) else list(order)
    missing = [name for name in names if name not in df.columns]
    if not names or missing:
        raise ValueError(f"order columns needed, missing: {missing or 'all'}")
    return names


def number_rows(df: DataFrame, *sort: Column | str, name: str = "row_no", total: str | None = None) -> DataFrame:
    """Number the rows 0, 1, 2 … in sort order; `total` names an optional column with the row count.

    Rows are range-partitioned and sorted, never brought into one task. Every row's partition and place are
    written down once, so that the sizes of the preceding partitions fit the rows they are added to. Pass key
    columns or a vocabulary-sized table: what comes in is what gets materialized.
    """
    placed = materialize(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_nr_slot", F.monotonically_increasing_id())
    )
    placed = placed.select(
        *df.columns,
        F.shiftrightunsigned("_nr_slot", _PLACE_BITS).alias("_nr_part"),
        F.col("_nr_slot").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_nr_place"),
    )
    # One row per partition, so neither the window nor the broadcast grows with the table.
    sizes = placed.groupBy("_nr_part").agg(F.count(F.lit(1)).alias("_nr_size"))
    before = Window.orderBy("_nr_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_nr_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        "_nr_part",
        F.coalesce(F.sum("_nr_size").over(before), F.lit(0)).alias("_nr_start"),
        F.sum("_nr_size").over(everything).alias("_nr_total"),
    )
    numbered = placed.join(F.broadcast(starts), "_nr_part")
    extra = [F.col("_nr_total").alias(total)] if total else []
    return numbered.select(*df.columns, (F.col("_nr_start") + F.col("_nr_place")).alias(name), *extra)


def number_keys(df: DataFrame, order: Sequence[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """The order columns of every row with its number, and how many there are; fails if they do not tell all apart."""
    order = _require_order(df, order)
    # Grouped first: the range partitioning then samples the shuffled keys instead of scanning the table again.
    keys = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    numbered = number_rows(keys, *order, name=name)
    unclear = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in order]) | (F.col("_n") > 1)
    size = numbered.agg(F.count(F.lit(1)).alias("total"), F.count_if(unclear).alias("unclear")).first()
    if size["unclear"]:
        raise ValueError(f"{order} are null or repeated in some rows, so the numbering would not be defined")
    return numbered.drop("_n"), size["total"]


def with_row_keys(df: DataFrame, order: Sequence[str], source: str = "source", name: str = "row_key") -> DataFrame:
    """Add `<source>-<n>` keys, with one counter running over all sources in the given order. Runs jobs when called.

    Only the order columns are sorted and numbered; the rows then meet their numbers in one join.
    """
    order = _require_order(df, order)
    numbered, _ = number_keys(df, order, name="_row_no")
    keyed = df.join(numbered, order)
    key = F.concat(F.coalesce(F.col(source), F.lit("None")), F.lit("-"), F.col("_row_no").cast("string"))
    return keyed.withColumn(name, key).drop("_row_no")


def _at_most(name: str, bound) -> Column:
    """Order column not after `bound`, nulls first; a plain comparison, which reaches the file scan."""
    if bound is None:
        return F.col(name).isNull()
    return F.col(name).isNull() | (F.col(name) <= F.lit(bound))


def _cut(keys: DataFrame, order: list[str], n: int) -> tuple | None:
    """The keys of row n + 1 and of row n; None if there are no more than n rows."""
    if n <= FEW_ROWS:
        first = keys.orderBy(*order).limit(n + 1).collect()
        return (first[n], first[n - 1]) if len(first) > n else None
    numbered = number_rows(keys, *order, name="_no")
    found = {row["_no"]: row for row in numbered.where(F.col("_no").isin(n - 1, n)).collect()}
    return (found[n], found[n - 1]) if n in found else None


def head_rows(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first n rows in order; None keeps all, 0 keeps none.

    The cut is found on the order columns alone, by jobs that run when called: from their first n if those are few, and
    by numbering all keys in sorted ranges if not. The rows are then filtered where they lie, so the result stays
    spread over the cluster, unlike that of a sort with a limit. Rows with the keys of the cut itself are taken in
    any choice that makes n.
    """
    order = _require_order(df, order)
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    cut = _cut(df.select(*order), order, n)
    if cut is None:
        return df
    first_out, last_in = ([row[name] for name in order] for row in cut)
    bound = F.struct(*[F.lit(v).cast(df.schema[name].dataType).alias(name) for name, v in zip(order, first_out)])
    near = df.where(_at_most(order[0], first_out[0]))
    before = near.where(F.struct(*order) < bound)
    if first_out != last_in:
        return before
    # The cut runs through equal keys; only as many of them may remain as are missing.
    missing = n - before.select(*order).count()
    return before.unionByName(near.where(F.struct(*order) == bound).limit(missing))


def sample_rows(
    df: DataFrame, key: Sequence[str], k: int = DEFAULT_SAMPLE_ROWS, seed: int = DEFAULT_SEED
) -> DataFrame:
    """k rows picked by the hash of key and seed: the same rows at any partitioning."""
    key = _require_order(df, key)
    digest = F.md5(F.concat_ws(":", *[F.col(name).cast("string") for name in key], F.lit(str(seed))))
    ranked = df.withColumn("_digest", digest)
    # The leading digits as a number order rows as the whole digest does.
    ranked = ranked.withColumn("_lead", F.conv(F.substring("_digest", 1, 15), 16, 10).cast("bigint"))
    return head_rows(ranked, ["_lead", "_digest", *key], k).drop("_lead", "_digest")


# A Feistel network mixes a number's halves in so many rounds.
FEISTEL_ROUNDS = 6
# Numbers beyond the table are permuted again; half of them at most stay beyond each time.
_WALK_STEPS = 120


def permuted(number: Column, size: int, seed: int = DEFAULT_SEED) -> Column:
    """A keyed permutation of 0 … size - 1, computed for each number by itself.

    A Feistel network over the least even number of bits that holds `size` permutes these bits; whatever comes out beyond
    the last number is put in again until it does not (cycle walking), which keeps the permutation one of 0 … size - 1. Round values
    are the leading digits of an MD5 hash, which any engine can compute.
    """
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(value: Column) -> Column:
        left, right = F.shiftright(value, half), value.bitwiseAND(F.lit(mask))
        for turn in range(FEISTEL_ROUNDS):
            digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), right.cast("string")))
            drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").bitwiseAND(F.lit(mask))
            left, right = right, left.bitwiseXOR(drawn)
        return F.shiftleft(left, half) + right

    def again(value: Column, _: Column) -> Column:
        # The round function reads each half twice, so it runs on a bound value.
        step = F.element_at(F.transform(F.array(value), mixed), 1)
        return F.when((value >= 0) & (value < size), value).otherwise(step)

    first = F.element_at(F.transform(F.array(number.cast("bigint")), mixed), 1)
    walked = F.reduce(F.sequence(F.lit(1), F.lit(_WALK_STEPS)), first, again)
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("the permutation did not settle")))


def draw_rows(
    df: DataFrame, order: Sequence[str], k: int = DEFAULT_SAMPLE_ROWS, seed: int = DEFAULT_SEED
) -> DataFrame:
    """k different rows in random order; adds `draw` (from 1) and `row_no`, the row's place in `order` from 0.

    Draw i takes the row at the i-th place of a keyed permutation, so any k gives exactly k rows (all, if there are fewer),
    the same at any partitioning, and a greater k only adds draws. Places are computed where they are needed, never on
    the driver; order columns are numbered in sorted ranges. Runs jobs when called.
    """
    order = _require_order(df, order)
    numbered, total = number_keys(df, order)
    k = max(0, min(k, total))
    places = df.sparkSession.range(k).select(
        permuted(F.col("id"), max(1, total), seed).alias("row_no"), (F.col("id") + 1).alias("draw")
    )
    if k <= BROADCAST_ROWS:
        places = F.broadcast(places)
    picked = numbered.join(places, "row_no")
    return df.join(F.broadcast(picked) if k <= BROADCAST_ROWS else picked, order)


def _digest(df: DataFrame, names: Sequence[str]) -> Column:
    """256 bits that tell values of columns apart, nulls included."""
    return F.unhex(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in order; of rows that agree in keys and order, any one.

    Keys are told apart by a digest. Each task keeps one order per digest before the shuffle, so a group of copies of any
    size is harmless; whole rows are only joined with what is kept, by digest and place, and never sorted by content.
    """
    order = _require_order(df, order)
    marked = df.withColumns({"_digest": _digest(df, list(keys)), "_place": _digest(df, order)})
    first = F.min(F.struct(*order, "_place"))
    kept = marked.groupBy("_digest").agg(first.alias("_first")).select("_digest", F.col("_first._place").alias("_place"))
    rows = marked.join(kept, ["_digest", "_place"], "left_semi")
    again = F.row_number().over(Window.partitionBy("_digest", "_place").orderBy("_place"))
    return rows.withColumn("_again", again).where("_again = 1").drop("_again", "_digest", "_place")
