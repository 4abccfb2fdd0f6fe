"""Hard negatives for anchors: rotated one-bit codes, certain intervals of scores, exact integer scores.

A vector o is rotated at random and stored as the signs of its components, the code b (a unit vector along the signs),
with its alignment <o, b>. For a query q the popcount of the code against the bit planes of the rounded query gives
<q, b>; then <q, o> = <q, b><o, b> + <q', o'>, where q' and o' are what is left of both beside b, and |<q', o'>| is at most
|q'||o'| by Cauchy and Schwarz. Rows whose interval cannot reach an answer are passed over; the others are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, new_folder
from lexloom.llm.embeddings import _by_size

DEFAULT_SEED = 42
# Rounded queries have so many bit planes.
PLANES = 8
# Anchors go to every executor in blocks of about so many bytes, one job each.
BLOCK_BYTES = 4 << 20
# Rows and anchors that meet at once in a task.
CHUNK_ROWS, CHUNK_ANCHORS = 256, 512
# Room for rounding in the bounds of an interval, as a share of the norms' product.
SLACK = 1e-9

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantize(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; fails if a component leaves no room for exact scores."""
    whole = np.floor(scale * vectors.astype(np.float64))
    if whole.size and np.abs(whole).max() >= 1 << 31:
        raise ValueError("components beyond 2^31 after scaling have no exact 64-bit scores")
    return whole.astype(np.int64)


@lru_cache(maxsize=4)
def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix that depends on size and seed alone."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Codes:
    """Sign codes of rotated vectors with norms and alignments."""

    def __init__(self, vectors: np.ndarray, seed: int):
        size = vectors.shape[1]
        turned = vectors @ rotation(size, seed)
        self.bits = pack_bits(turned > 0)
        self.norm = np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1))
        self.along = np.abs(turned).sum(axis=1) / np.sqrt(max(1, size))
        self.beside = np.sqrt(np.maximum(0, self.norm**2 - self.along**2))


def pack_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words."""
    if not signs.shape[1]:
        return np.zeros((len(signs), 1), "<u8")
    packed = np.packbits(signs, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


class Queries:
    """Rotated queries rounded to `PLANES` bits a component, as bit planes."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.size = vectors.shape[1]
        turned = vectors @ rotation(self.size, seed)
        self.norm = np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1))
        self.low = turned.min(axis=1, initial=0)
        width = turned.max(axis=1, initial=0) - self.low
        self.step = np.where(width > 0, width / ((1 << PLANES) - 1), 1)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [pack_bits(levels >> j & 1 == 1) for j in range(PLANES)]
        self.total = levels.sum(axis=1)
        rest = turned - (self.low[:, None] + self.step[:, None] * levels)
        # How far the rounded query may be off along any code.
        self.off = np.abs(rest).sum(axis=1) / np.sqrt(max(1, self.size))

    def intervals(self, codes: Codes, rows: slice, mine: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each row with each query, certain up to nothing but rounding."""
        bits = codes.bits[rows]
        above = np.zeros((len(bits), len(self.total[mine])))
        for j, plane in enumerate(self.planes):
            shared = np.bitwise_count(bits[:, None, :] & plane[mine][None, :, :]).sum(axis=2, dtype=np.int64)
            above += float(1 << j) * shared
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        # The code is +1 where its bit is set and -1 elsewhere.
        signed = self.low[mine] * (2 * ones[:, None] - self.size) + self.step[mine] * (2 * above - self.total[mine])
        shadow = signed / np.sqrt(max(1, self.size))
        off, norm = self.off[mine], self.norm[mine]
        along, beside = codes.along[rows][:, None], codes.beside[rows][:, None]
        near = np.maximum(0, np.abs(shadow) - off)
        spread = np.sqrt(np.maximum(0, norm**2 - near**2)) * beside + off * along
        spread += SLACK * norm * codes.norm[rows][:, None] + SLACK
        return shadow * along - spread, shadow * along + spread


def exact_scores(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows r with queries q, pair by pair."""
    if not rows.shape[1]:
        return np.zeros(len(r), np.int64)
    bound = int(np.abs(rows).max()) * int(np.abs(queries).max()) * rows.shape[1]
    if bound >= HIGHEST:
        # Python's integers, where 64 bits might not do.
        return np.array([int(a.astype(object) @ b.astype(object)) for a, b in zip(rows[r], queries[q])], np.int64)
    if bound < 1 << 53 and 4 * len(r) > len(rows) * len(queries):
        # Where most pairs survive, one product gives them; every partial sum is a whole number that a double holds.
        return (rows.astype(np.float64) @ queries.astype(np.float64).T)[r, q].astype(np.int64)
    return np.einsum("ij,ij->i", rows[r], queries[q])


class Best:
    """The best `k` rows of every query slot seen so far: higher scores first, then smaller keys, null keys last."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = self.score = self.key = self.row = np.zeros(0, np.int64)
        self.least = np.full(slots, LOWEST)

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        slot, score, key, row = (np.concatenate([a, b]) for a, b in zip((self.slot, self.score, self.key, self.row), (slot, score, key, row)))
        order = np.lexsort((row, key, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.k
        full = place == self.k - 1
        self.least[slot[full]] = score[order][full]
        self.slot, self.score, self.key, self.row = slot[keep], score[order][keep], key[order][keep], row[order][keep]


def _scan(rows: DataFrame, anchors: pa.Table, windows: dict | None, k: int, same: bool, seed: int) -> DataFrame:
    """`(slot, score, key, row, rank)`: the best `k` rows for each slot of a block of anchors, written down.

    Rows have equal labels (`same`) or different ones. Without windows every anchor is a slot; else slots are
    `(anchor, low, high)` and take rows whose score lies within their bounds.
    """
    names = anchors.column("row").to_numpy()
    labels = anchors.column("label").to_numpy()
    whole = {size: (at, whole) for size, at, whole in _integers(anchors.column("whole").combine_chunks())}
    if windows is None:
        owner, low, high = np.arange(len(names)), np.full(len(names), LOWEST), np.full(len(names), HIGHEST)
    else:
        owner, low, high = windows["anchor"], windows["low"], windows["high"]
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((names, labels, whole, owner, low, high))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels, whole, owner, low, high = sent.value
        best = Best(len(owner), k)
        queries = {size: Queries(vectors, seed) for size, (_, vectors) in whole.items()}
        # Slots of an anchor lie behind each other.
        first = np.searchsorted(owner, np.arange(len(names)))
        count = np.searchsorted(owner, np.arange(len(names)), "right") - first
        for batch in batches:
            all_keys = batch.column("key").fill_null(HIGHEST).to_numpy()
            all_rows, all_labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            for size, at, vectors in _integers(batch.column("whole")):
                if size not in whole:
                    continue
                mine, asked = whole[size]
                codes = Codes(vectors, seed)
                for a in range(0, len(at), CHUNK_ROWS):
                    for b in range(0, len(mine), CHUNK_ANCHORS):
                        some, them = slice(a, a + CHUNK_ROWS), slice(b, b + CHUNK_ANCHORS)
                        agree = all_labels[at[some]][:, None] == labels[mine[them]]
                        fits = agree if same else ~agree
                        if same:
                            fits &= all_rows[at[some]][:, None] != names[mine[them]]
                        lowest, highest = queries[size].intervals(codes, some, them)
                        # What an anchor still asks for: between the least of its bounds or tenth bests and the highest bound.
                        wanted = np.maximum(low, best.least)
                        here = mine[them]
                        floor = np.full(len(here), HIGHEST)
                        ceiling = np.full(len(here), LOWEST)
                        has = count[here] > 0
                        if has.any():
                            spans = np.column_stack([first[here][has], (first + count)[here][has]]).ravel()
                            floor[has] = np.minimum.reduceat(np.append(wanted, HIGHEST), spans)[::2]
                            ceiling[has] = np.maximum.reduceat(np.append(high, LOWEST), spans)[::2]
                        fits &= (highest >= floor) & (lowest <= ceiling) & has
                        r, q = np.nonzero(fits)
                        if not len(r):
                            continue
                        score = exact_scores(vectors[some], asked[them], r, q)
                        # Each survivor meets the slots of its anchor.
                        slots = count[here[q]]
                        pair = np.repeat(np.arange(len(r)), slots)
                        slot = np.repeat(first[here[q]], slots) + np.arange(len(pair)) - np.repeat(np.cumsum(slots) - slots, slots)
                        keep = (score[pair] >= wanted[slot]) & (score[pair] <= high[slot])
                        pair, slot = pair[keep], slot[keep]
                        place = at[a + r[pair]]
                        best.add(slot, score[pair], all_keys[place], all_rows[place])
        keys = pa.array(best.key, mask=best.key == HIGHEST)
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), keys, pa.array(best.row)], ["slot", "score", "key", "row"])

    found = rows.mapInArrow(scan, "slot bigint, score bigint, key bigint, row bigint")
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    told = materialize(ranked.where(F.col("rank") <= k))
    sent.destroy()
    return told


def _integers(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """`(size, places, matrix)` for the integer vectors of each dimension in a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, flat[starts[at][:, None] + np.arange(size)]


def complete(vector: Column) -> Column:
    """Whether a vector is not null and has no null or non-finite component."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def prepare(rows: DataFrame, asks: Column, key: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """`(row, key, asks, label, whole)` for rows that take part, with integer vectors, written down."""
    chosen = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("bigint").alias("key"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        label.cast("bigint").alias("label"),
        F.col(vector).alias("vector"),
    )
    chosen = chosen.where(F.col("label").isNotNull() & complete(F.col("vector")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None] * batch.num_rows
            for at, vectors in _by_size(batch.column("vector")):
                for i, v in zip(at.tolist(), quantize(vectors, scale)):
                    made[i] = v
            columns = [batch.column(n) for n in ("row", "key", "asks", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.int64()))], ["row", "key", "asks", "label", "whole"])

    return materialize(chosen.mapInArrow(whole, "row bigint, key bigint, asks boolean, label bigint, whole array<bigint>"))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` for anchors, their positives and negatives.

    Vectors become integers, `floor(scale * x)`, and scores are their inner products. An anchor's positives are its best
    `positives` other rows of the same label; for each of them, its negatives are the best `negatives` rows of another
    label whose score is between `low` and `high` percent of the positive's. Higher scores come first, ties by smaller
    key, null keys last. `is_anchor` reads `key`; null counts as no.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different
    dimensions never meet; empty ones have score 0. Rows that repeat a key are rows of their own, and so are their
    answers. Anchors without positives or negatives, and empty tables, give no rows. All rows are compared with the
    anchors, which travel in blocks of bounded size; a task holds the best rows of one block only.
    """
    named = F.col(label) if isinstance(label, str) else label
    taking = prepare(rows, is_anchor, key, named, vector, scale)
    asking = taking.where("asks")
    size = asking.agg(F.coalesce(F.sum(F.size("whole") * 8 + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = size // BLOCK_BYTES + 1
    asking = materialize(asking.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks))), ("block",))
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession)
    for block in range(blocks):
        anchors = asking.where(F.col("block") == block).select("row", "key", "label", "whole").toArrow()
        near = _scan(taking, anchors, None, positives, True, seed).orderBy("slot", "rank").toArrow()
        scores = near.column("score").to_numpy()
        # low * p <= 100 * n <= high * p, in whole numbers.
        windows = {"anchor": near.column("slot").to_numpy(), "low": -(-low * scores // 100), "high": high * scores // 100}
        far = _scan(taking, anchors, windows, negatives, False, seed)
        pairs = pa.table(
            {
                "slot": pa.array(np.arange(len(scores))),
                "anchor_id": anchors.column("key").take(near.column("slot")),
                "positive_id": near.column("key"),
                "positive_score": near.column("score"),
            }
        )
        told = far.join(F.broadcast(spark.createDataFrame(pairs)), "slot")
        columns = ["anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        told.select(*columns).write.parquet(f"{folder}/part={block}")
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(kinds).parquet(folder).drop("part")
