"""Shards of nearly equal bytes by histogram sort: refine probes until splitters hold, then exchange once."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.llm.shared import quoted

# Every round looks at so many bits of the keys.
ROUND_BITS = 8
KEY_BITS = 64
# The lowest bits of a key tell rows with equal texts apart. Splitters only get there if the bits above do not suffice.
WITHIN_BITS = 24
# A splitter holds if it is off by at most this share of a shard's bytes.
TOLERANCE = 0.002
# A group of equal texts is only cut if a splitter beside it would be off by more than this share.
GROUP_TOLERANCE = 0.005


def shard_key(text: Column, key: Column) -> Column:
    """A bigint that orders rows by a hash of their text and, within equal texts, by a hash of their key."""
    within = (1 << WITHIN_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~within)).bitwiseOR(F.xxhash64(key, text).bitwiseAND(F.lit(within)))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text and one; one for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _prefix(bits: int) -> Column:
    """The leading bits of a key as a number that is ordered as keys are, the smallest key first."""
    return F.shiftright("_key", KEY_BITS - bits)


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, finer: int = 1) -> list[int]:
    """The keys at which shards 1, 2 … begin, from `(_key, _size)`; with `finer`, those of `finer` parts of each shard.

    Each round sums bytes by the next few bits of those keys whose leading bits hold an unsettled splitter: at most
    2^`ROUND_BITS` sums per splitter, aggregated in each task before the shuffle. The sums before a candidate are exact
    at every round. A splitter is settled at the candidate nearest to its target once it is within the tolerance, which
    is wider where finer candidates would cut groups of equal texts, or when there are no bits left.
    """
    parts = shards * finer
    total = keyed.agg(F.sum("_size").alias("n")).first()["n"] or 0
    targets = {i: total * i / parts for i in range(1, parts)}
    settled: dict[int, int] = {}
    # For an unsettled splitter: the leading bits that hold it and the bytes before them.
    inside = {i: (None, 0) for i in targets}
    bits = 0
    while inside and total:
        bits += ROUND_BITS
        share = max(tolerance, GROUP_TOLERANCE) if bits == KEY_BITS - WITHIN_BITS else tolerance
        slack = share * total / shards
        rows = keyed
        if bits > ROUND_BITS:
            open_prefixes = sorted({prefix for prefix, _ in inside.values()})
            rows = keyed.where(_prefix(bits - ROUND_BITS).isin(open_prefixes))
        sums: dict[int | None, tuple[list[int], list[int]]] = {}
        for row in rows.groupBy(_prefix(bits).alias("p")).agg(F.sum("_size").alias("n")).orderBy("p").collect():
            # Places below the same leading bits, and the bytes up to each.
            places, ends = sums.setdefault(row["p"] >> ROUND_BITS if bits > ROUND_BITS else None, ([], []))
            places.append(row["p"])
            ends.append(row["n"] + (ends[-1] if ends else 0))
        following = {}
        for i, (prefix, before) in inside.items():
            places, ends = sums[prefix]
            at = min(bisect_left(ends, targets[i] - before), len(ends) - 1)
            below, above = before + (ends[at - 1] if at else 0), before + ends[at]
            low, high = targets[i] - below, above - targets[i]
            if min(low, high) <= slack or bits == KEY_BITS:
                settled[i] = (places[at] + (low > high)) << (KEY_BITS - bits)
            else:
                following[i] = (places[at], below)
        inside = following
    return [settled[i] for i in sorted(settled)]


def shard_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters that are not above a key, found by halving."""
    highest = (1 << (KEY_BITS - 1)) - 1

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        if splitters[middle] > highest:
            return within(low, middle)
        return F.when(key < F.lit(splitters[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(splitters))


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, keep: list[str] | None = None
) -> DataFrame:
    """The documents (or the columns `keep`) with `_size, _shard, _slot`, sharded by nearly equal bytes.

    Sizes are the text's UTF-8 bytes plus one. Rows are ordered by a hash of the text, so equal texts are neighbours and
    share a shard unless a splitter has to cut a group that is too large; the same rows get the same shards at any
    partitioning. Slots count from 0 in each shard without gaps. A null text is one byte, null keys are keys, repeated
    rows are neighbours, more shards than rows leave shards empty, and an empty table gives no rows. Columns
    named `_size`, `_shard` or `_slot` are replaced.

    Keys and sizes are written once for the rounds. The rounds find the splitters of finer parts too, and rows are
    exchanged once, to the partition of their part, and sorted there by key and, where keys agree, by the document's key
    and a hash of the row. So the same rows get the same slots at any partitioning. The numbers of rows per partition
    give the slots.
    """
    names = [c for c in (keep or docs.columns) if c not in ("_size", "_shard", "_slot")]
    keyed = materialize(docs.select(shard_key(F.col(text), F.col(key)).alias("_key"), text_bytes(F.col(text)).alias("_size")))
    finer = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    splitters = find_splitters(keyed, shards, tolerance, finer)
    whole = F.struct(*[quoted(name) for name in names])
    rows = docs.select(
        whole.alias("_row"),
        text_bytes(F.col(text)).alias("_size"),
        shard_key(F.col(text), F.col(key)).alias("_key"),
        F.col(key).alias("_tie"),
        F.xxhash64(F.to_json(whole)).alias("_tie2"),
    ).withColumn("_fine", shard_of(F.col("_key"), splitters))
    rows = rows.repartitionById(shards * finer, F.col("_fine").cast("int")).sortWithinPartitions("_fine", "_key", "_tie", "_tie2")
    rows = rows.withColumn("_shard", F.floor(F.col("_fine") / finer)).drop("_key", "_tie", "_tie2", "_fine")
    placed = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    # One row per range and shard it touches: at most ranges + shards.
    spans = placed.groupBy("_shard", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = F.expr("coalesce(sum(_n) OVER (PARTITION BY _shard ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = spans.withColumn("_before", earlier).select("_shard", "_part", (F.col("_before") - F.col("_first")).alias("_shift"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), ["_shard", "_part"])
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in names], "_size", F.col("_shard").cast("int").alias("_shard"), (F.col("_at") + F.col("_shift")).alias("_slot")
    )
