"""Mixing sources to target weights: repetition rates per source, whole copies and one drawn copy per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.llm.shared import count_words, whole_row
from lexloom.operators.lookup import attach
from lexloom.operators.order import number_rows

MAX_REPEATS = 3
DEFAULT_SEED = 42
# A draw is a number below 2^52, taken from the leading hex digits of a digest.
_DRAW_DIGITS = 13


def cycled_weights(sizes: DataFrame, source: str, cycle: int = 3) -> DataFrame:
    """Weights 1, 2 … `cycle`, repeating, over the sources by code point, null last."""
    ranked = number_rows(sizes.select(source), F.col(source).asc_nulls_last(), name="_rank")
    return ranked.select(source, (F.col("_rank") % cycle + 1).cast("bigint").alias("weight"))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add `target` to `(…, source_size, weight)`: the share of all sizes by weight, at most `max_repeats` times
    the source's size; what sources cannot take is shared by the others by weight until none is above.

    A round is one aggregate over the sources. Every round but the last fills at least one more source; in terms of
    the level (what a unit of weight gets) rounds only go up, so a source once full stays full.
    """
    cap = F.col("source_size") * max_repeats
    full = F.lit(False)
    while True:
        state = sizes.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap).otherwise(0)).alias("taken"),
            F.sum(F.when(full, F.lit(0)).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("full"),
        ).first()
        rest, weight = (state["total"] or 0) - (state["taken"] or 0), state["weight"] or 0
        if not weight:
            break
        # source is above its cap: weight * rest / all weights > cap, in whole numbers
        now = F.col("weight").cast("decimal(38,0)") * F.lit(rest) > cap.cast("decimal(19,0)") * F.lit(weight)
        if sizes.agg(F.count_if(full | now).alias("n")).first()["n"] == state["full"]:
            break
        full = full | now
    shared = F.col("weight") * F.lit(rest).cast("double") / F.lit(weight or 1).cast("double")
    return sizes.withColumn("target", F.when(full, cap.cast("double")).otherwise(shared))


def copies(rate: Column, key: Column, seed: int = DEFAULT_SEED) -> Column:
    """`floor(rate)` copies and one more with the fraction's probability, drawn by a digest of seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    draw = F.conv(F.substring(digest, 1, _DRAW_DIGITS), 16, 10).cast("bigint") / F.lit(float(16**_DRAW_DIGITS))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("bigint")


def plan_mixture(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: DataFrame | None = None,
    max_repeats: int = MAX_REPEATS,
    seed: int = DEFAULT_SEED,
    size: Column | None = None,
) -> DataFrame:
    """The documents with `_size, _source_size, _target, _rate, _copies`, which replace columns of these names.

    `weights` has a column of sources, first, and `weight`, whole numbers; sources without one get none, and without `weights` they
    cycle through 1, 2, 3. A null text has size 0, a null source is a source, a source of size 0 has rate 0. Rows
    with equal keys share their draw; all null keys do. An empty table gives no rows. Sizes are aggregated per source
    in each task, and sources meet documents by `attach`, so neither many sources nor one large one matter.
    """
    sized = docs.withColumn("_size", count_words(F.col(text)) if size is None else size)
    # A null source gets a name of its own for the joins; the prefix keeps it apart from all others.
    named = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    sizes = materialize(sized.groupBy(F.col(source).alias("_source")).agg(F.sum("_size").alias("source_size")))
    if weights is None:
        weights = cycled_weights(sizes, "_source")
    else:
        weights = weights.select(weights.columns[0], "weight").toDF("_source", "weight").withColumn("weight", F.col("weight").cast("bigint"))
    same = sizes["_source"].eqNullSafe(weights["_source"])
    weighed = sizes.join(weights, same, "left").select(
        sizes["_source"], "source_size", F.coalesce("weight", F.lit(0)).alias("weight")
    )
    targets = source_targets(materialize(weighed), max_repeats)
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    rates = materialize(
        targets.select(
            F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null")).alias("_named"),
            F.col("source_size").alias("_source_size"),
            F.col("target").alias("_target"),
            rate.alias("_rate"),
        )
    )
    planned = attach(sized.withColumn("_named", named), rates, ["_named"], [key])
    return planned.withColumn("_copies", copies(F.col("_rate"), F.col(key), seed)).drop("_named")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture itself: every document as often as its plan says, with the columns of `docs`, whatever their names."""
    packed = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        count_words(F.col(text)).alias("words"),
        whole_row(docs).alias("row"),
    )
    planned = plan_mixture(packed, "key", source="source", size=F.col("words"), **options).where("_copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
