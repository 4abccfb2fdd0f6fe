"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.llm.components import connected_components
from lexloom.operators.lookup import attach

DEFAULT_SEED = 42
# Code bits are chosen so that an even spread leaves about so many vectors of a label per bucket …
BUCKET_ROWS = 128
MAX_BITS = 40
# … and tables so that a pair exactly at the threshold meets in one of them with this probability.
RECALL = 1 - 1e-6
# A larger bucket is compared in blocks of about so many rows, each pair of blocks in a task of its own.
BLOCK_ROWS = 2_048


def hashing_plan(rows: int, threshold: float, bucket_rows: int = BUCKET_ROWS, recall: float = RECALL) -> tuple[int, int]:
    """`(bits, tables)` for the number of vectors of the largest label: the same rule at every size."""
    bits = min(MAX_BITS, max(1, round(math.log2(max(2, rows / bucket_rows)))))
    together = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, 1 if together >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - together))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, and not zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(places, matrix)` for the vectors of each dimension in a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def sign_codes(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """`(key, label, vector, codes)` with one code of `bits` signs per table; planes depend on seed and dimension."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for at, vectors in _by_size(batch.column("vector")):
                size = vectors.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * bits))
                signs = _unit(vectors) @ planes[size] > 0
                codes[at] = signs.reshape(-1, tables, bits) @ weights
            made = pa.array(list(codes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "codes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(code, f"{fields}, codes array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """The rows of each value of `by`; rows with equal values come behind each other, possibly in several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(by).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[-1].column(by)[0].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(values):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _block_links(sides, codes, vectors, weights, table: int, threshold: float):
    """Of one bucket block: links first met in this table, per row, and for each row the smallest linked place.

    `sides` tells the rows of the first block (0) from those of the second (1); a block meets itself if there is
    only one side.
    """
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    itself = len(right) == 0
    if itself:
        right = left
    close = vectors[left] @ vectors[right].T >= threshold
    if itself:
        np.fill_diagonal(close, False)
    first = close.copy()
    rows, columns = np.nonzero(first)
    if table:
        met = (codes[left[rows], :table] == codes[right[columns], :table]).any(axis=1)
        first[rows[met], columns[met]] = False
    counts = np.zeros(len(sides), np.int64)
    counts[left] += first @ weights[right]
    if not itself:
        counts[right] += weights[left] @ first
    # A forest of links suffices for components: smallest labels move along links until nothing changes.
    root = np.arange(len(sides))
    while len(rows):
        before = root.copy()
        np.minimum.at(root, left[rows], root[right[columns]])
        np.minimum.at(root, right[columns], root[left[rows]])
        root = root[root]
        if (root == before).all():
            break
    return counts, root


def linked_vectors(
    rows: DataFrame, threshold: float, key: str, label: str, vector: str, bits: int, tables: int, seed: int = DEFAULT_SEED,
    block_rows: int = BLOCK_ROWS, weight: str | None = None,
) -> DataFrame:
    """`(row, other, n_links)`: per task and row the number of links found, and another row of its component or none.

    Rows meet the rows of their label with the same code in each table. Buckets are counted first; one of more than
    `block_rows` rows is dealt over blocks, and every pair of blocks is a group of its own, so no task gets an
    unbounded group. A pair is counted in the first table where its codes agree, so that it counts once, and as often
    as the other row stands for a vector (`weight`). Only counts and one forest edge per row leave a block, never its pairs.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    chosen = rows.select(F.col(key).alias("row"), F.col(label).alias("label"), F.col(vector).alias("vector"), times.alias("weight"))
    coded = materialize(sign_codes(chosen, bits, tables, seed))
    slots = coded.select("row", "label", "codes", F.posexplode("codes").alias("table", "code"))
    counted = slots.groupBy("label", "table", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = materialize(counted.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).drop("n"))
    placed = attach(slots, counted, ["label", "table", "code"], ["row"]).where("blocks IS NOT NULL")
    mine = F.pmod(F.xxhash64("row", F.lit(seed)), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine)
    # (block, block) is one group, (block, other) another with both sides.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "row",
        "table",
        F.xxhash64("label", "table", "code", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"),
        F.struct("label", "code", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).alias("exact"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    located = placed.join(coded.select("row", "vector", "codes", "weight"), "row")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = located.repartition(partitions, "group").sortWithinPartitions("group", "table", "exact", "side", "row")
    dealt = dealt.select(
        "row", "side", "table", "codes", "vector", "weight", F.to_json(F.struct("group", "table", "exact")).alias("bucket")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "bucket"):
            if run.num_rows < 2:
                continue
            ids = run.column("row").to_numpy()
            [(_, codes)] = _by_size(run.column("codes").combine_chunks())
            sides, weights = run.column("side").to_numpy(), run.column("weight").to_numpy()
            table = run.column("table")[0].as_py()
            # Vectors of different dimensions link with nothing.
            for at, vectors in _by_size(run.column("vector").combine_chunks()):
                if len(set(sides.tolist())) > 1 and len(set(sides[at].tolist())) < 2:
                    continue
                counts, root = _block_links(sides[at], codes[at].astype(np.int64), _unit(vectors), weights[at], table, threshold)
                told = np.flatnonzero((counts > 0) | (root != np.arange(len(at))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at][told]), pa.array(ids[at][root[told]]), pa.array(counts[told])], ["row", "other", "n_links"]
                )

    return dealt.mapInArrow(link, "row bigint, other bigint, n_links bigint")


def near_vectors(
    rows: DataFrame, threshold: float = 0.93, key: str = "vec_id", label: str = "label", vector: str = "embedding", seed: int = DEFAULT_SEED
) -> DataFrame:
    """`(key, n_links, component_id, kept)` for every row.

    Vectors link if their labels are equal and their cosine in double precision is at least `threshold`. Null labels
    and vectors without a direction link with nothing and are their own component. Null keys count as vectors, but a
    component is named after its smallest key that is not null. Rows that repeat a key are vectors of their own that
    link if their vectors do; an empty table gives no rows. `hashing_plan` sets how likely a pair exactly at the
    threshold is missed; pairs above it are missed less often.
    """
    source = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    # Rows get a number of their own, written down, as keys may be null or repeated.
    numbered = materialize(source.withColumn("row", F.monotonically_increasing_id()))
    good = numbered.where(F.col("label").isNotNull() & usable(F.col("vector")))
    # Equal vectors of a label are compared with others once, however many they are.
    same = {"c1": F.xxhash64("label", "vector"), "c2": F.xxhash64("vector", "label", F.lit(1))}
    classes = good.withColumns(same).groupBy("c1", "c2").agg(
        F.min("row").alias("class"), F.count(F.lit(1)).alias("times"), F.min_by(F.struct("label", "vector"), "row").alias("v")
    )
    classes = materialize(classes.select("c1", "c2", "class", "times", "v.label", "v.vector"))
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    bits, tables = hashing_plan(largest, threshold)
    found = materialize(linked_vectors(classes, threshold, "class", "label", "vector", bits, tables, seed, weight="times"))
    links = materialize(found.groupBy("row").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("row", "class"))
    roots = connected_components(found.select(F.col("row").alias("u"), F.col("other").alias("v")))
    usual = F.when(F.col("label").isNotNull() & usable(F.col("vector")), True)
    members = numbered.select("key", "row", *[F.when(usual, c).alias(n) for n, c in same.items()])
    rooted = attach(members, classes.select("c1", "c2", "class", "times"), ["c1", "c2"], ["row"]).drop("c1", "c2")
    rooted = attach(attach(rooted, roots.toDF("class", "root"), ["class"], ["row"]), links, ["class"], ["row"])
    n_links = F.coalesce("n_links", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1
    rooted = rooted.select("key", "row", F.coalesce("root", "class", "row").alias("root"), n_links.cast("bigint").alias("n_links"))
    firsts = materialize(rooted.groupBy("root").agg(F.min("key").alias("component_id")))
    named = attach(rooted, firsts, ["root"], ["row"])
    return named.select(
        F.col("key").alias(key),
        "n_links",
        F.col("component_id").cast("bigint").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
