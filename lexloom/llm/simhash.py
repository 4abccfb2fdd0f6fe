"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, release
from lexloom.llm.components import connected_components
from lexloom.llm.shared import slices, whole_row
from lexloom.operators.lookup import attach

BITS = 64
SEED = 42
# Bits of so many hashes are counted at once, in groups whose counts fit a byte.
_GROUP = 255
_CHUNK = _GROUP * 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for null and for texts without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    width = min(shingle, len(words))
    n = len(words) - width + 1
    starts = np.concatenate([[0], blanks + 1])[:n]
    ends = np.concatenate([blanks, [len(line)]])[width - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        even = len(bits) // _GROUP * _GROUP
        ones += bits[:even].reshape(-1, _GROUP, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[even:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """`fingerprint` as a bigint column with the same bits."""

    @F.arrow_udf("bigint")
    def signed(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, shingle) for some in slices(texts) for t in some]
        return pa.array(np.array(found, "<u8").view("<i8"))

    return signed(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), BITS // 4, "0")


def near_pairs(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links `(u, v)` between distinct fingerprints `fp` that connect all those at most `max_bits` bits apart.

    Every fingerprint emits all variants within half the radius (65 for two bits). Two within the radius share a
    variant, and no variant is shared by more than those within half the radius of it, so no group is large however
    many copies a text has. For an even radius a group's members all lie within the radius of each other, and the
    link to the smallest stands for all; for an odd one all pairs of the group are checked.
    """
    half = (max_bits + 1) // 2
    masks = [sum(1 << i for i in flips) for n in range(half + 1) for flips in combinations(range(BITS), n)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    flip = F.explode(F.array(*[F.lit(m).cast("bigint") for m in signed]))
    emitted = distinct.select("fp", flip.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    if max_bits % 2 == 0:
        grouped = emitted.selectExpr("fp AS u", "min(fp) OVER (PARTITION BY variant) AS v")
    else:
        grouped = emitted.toDF("u", "variant").join(emitted.toDF("v", "variant"), "variant")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    return grouped.where("u != v").where(close).select("u", "v").distinct()


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, also: dict[str, Column] | None = None
) -> DataFrame:
    """`(key, fp, component_id)` for every row: its fingerprint and the smallest key that links reach, itself included.

    Rows link if their fingerprints differ in at most `max_bits` bits. A null or blank text has fingerprint 0 and
    links like any other; null keys are never the smallest, and a component with null keys alone has a null id.
    Repeated rows stay. `also` adds columns made from `docs`. Fingerprints are written once; links are sought between
    distinct ones.
    """
    extra = also or {}
    rows = materialize(docs.select(F.col(key).alias("_key"), fingerprints(F.col(text), shingle).alias("fp"), *[c.alias(n) for n, c in extra.items()]))
    distinct = materialize(rows.groupBy("fp").agg(F.min("_key").alias("first")))
    roots = connected_components(near_pairs(distinct, max_bits))
    classed = attach(distinct, roots.toDF("fp", "root"), ["fp"], ["fp"]).withColumn("root", F.coalesce("root", "fp"))
    classed = materialize(classed)
    firsts = materialize(classed.groupBy("root").agg(F.min("first").alias("component_id")))
    named = materialize(attach(classed, firsts, ["root"], ["fp"]).select("fp", F.col("root"), "component_id"))
    for written in (distinct, classed, firsts):
        release(written)
    found = attach(rows, named, ["fp"], ["_key"])
    return found.select(F.col("_key").alias(key), "fp", "root", "component_id", *extra)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of every component, that with the smallest key, with all columns of `docs`.

    Null keys come last; rows of a component that agree in key and text are the same document, and any one stays.
    """
    mark = {"_k1": F.xxhash64(key, text), "_k2": F.xxhash64(text, key, F.lit(1))}
    rows = simhash_components(docs, key, text, shingle, max_bits, mark)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_k1", "_k2").alias("o")
    counted = materialize(rows.groupBy("root", order).agg(F.count(F.lit(1)).alias("n")))
    best = materialize(counted.groupBy("root").agg(F.min("o").alias("best")))
    judged = attach(counted, best, ["root"], ["o"]).select("o._k1", "o._k2", "n", (F.col("o") != F.col("best")).alias("drop"))
    # Only rows that go, or that repeat a row that stays, are looked up; all others stay where they are.
    fates = materialize(judged.where("drop OR n > 1").select("_k1", "_k2", "drop"))
    packed = docs.select(*[c.alias(n) for n, c in mark.items()], F.monotonically_increasing_id().alias("spread"), whole_row(docs).alias("row"))
    looked = attach(packed, fates, ["_k1", "_k2"], ["spread"])
    several = looked.where("NOT drop").groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    return looked.where("drop IS NULL").select("row").unionByName(several.select("row")).select("row.*")
