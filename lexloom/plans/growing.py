"""Word counts of a corpus that grows: parts are counted once, added and withdrawn, and merged instead of recounted.

A state is a folder: `parts/<name of a write>` holds the counts of one part, `manifest/v=<n>` lists the parts that belong to
version n. A version counts once its manifest is complete, so a job that dies leaves the version before it as it was, and
what it had written is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.tokens import _with_ids, _word_ids, pretokenize
from lexloom.schemas import WORD_PATTERN

MANIFEST = "part string, part_no bigint, digest string, folder string"
COUNTS = "word string, cnt bigint, first array<bigint>"


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, state: str) -> list[int]:
    """The complete versions of a state, ascending; none for a folder that is missing or empty."""
    target, files = _hadoop(spark, f"{state}/manifest")
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    found = sorted(int(name[2:]) for name in names if name.startswith("v="))
    return [v for v in found if files.exists(_hadoop(spark, f"{state}/manifest/v={v}/_SUCCESS")[0])]


def manifest(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """The parts of a version, the last by default: name, number in order of arrival, digest and folder."""
    known = versions(spark, state)
    if version is None and not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{state}/manifest/v={known[-1] if version is None else version}")


def count_part(part: DataFrame, order: Sequence[str], text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """`(word, cnt, first)`: counts, and the least place (order…, pos) as an array of integers, null before all others."""
    place = F.array(*[F.col(name).cast("bigint") for name in order], F.col("pos").cast("bigint"))
    words = pretokenize(part, list(order), text, pattern=pattern)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), F.min(place).alias("first"))


def part_digest(part: DataFrame, order: Sequence[str], text: str = "text") -> str:
    """What tells the content of a part, whatever the order and partitioning of its rows."""
    row = F.xxhash64(*order, text)
    again = F.xxhash64(text, *order, F.lit(1))
    sums = [F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string") for h in (row, again)]
    return "-".join(map(str, part.agg(F.count(F.lit(1)).cast("string"), *sums).first()))


def update_counts(
    spark: SparkSession,
    state: str,
    add: Mapping[str, DataFrame] | None = None,
    withdraw: Sequence[str] = (),
    order: Sequence[str] = (),
    text: str = "text",
    pattern: str = WORD_PATTERN,
) -> int:
    """A new version of a state, with parts added and withdrawn; returns its number.

    An added part that the state has with the same content stays as it is; one with other content is counted anew in its
    old place. Only new and changed parts are read in full. Withdrawing an unknown part fails and leaves the
    state unchanged. `order` identifies the rows of a part and consists of integers; parts come in order of arrival.
    """
    entries = {row["part"]: row.asDict() for row in manifest(spark, state).collect()}
    unknown = [name for name in withdraw if name not in entries]
    if unknown:
        raise ValueError(f"not in the state: {unknown}")
    kept = {name: entry for name, entry in entries.items() if name not in withdraw}
    following = max((entry["part_no"] for entry in entries.values()), default=-1) + 1
    for name, part in (add or {}).items():
        digest = part_digest(part, order, text)
        if name in kept and kept[name]["digest"] == digest:
            continue
        folder = f"parts/{uuid.uuid4().hex}"
        count_part(part, order, text, pattern).write.parquet(f"{state}/{folder}")
        number = kept[name]["part_no"] if name in kept else following
        following = max(following, number + 1)
        kept[name] = {"part": name, "part_no": number, "digest": digest, "folder": folder}
    version = max(versions(spark, state), default=0) + 1
    rows = [tuple(entry[name] for name in ("part", "part_no", "digest", "folder")) for entry in kept.values()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{state}/manifest/v={version}")
    return version


def merged_words(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """`(word, cnt, part_no, first)` of all parts of a version, as a count of the whole corpus would give."""
    parts = [
        spark.read.schema(COUNTS).parquet(f"{state}/{row['folder']}").withColumn("part_no", F.lit(row["part_no"]).cast("bigint"))
        for row in manifest(spark, state, version).collect()
    ]
    if not parts:
        return spark.createDataFrame([], "word string, cnt bigint, part_no bigint, first array<bigint>")
    merged = reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("part_no", "first")).alias("f"))
    return merged.select("word", "cnt", "f.part_no", "f.first")


def merged_counts(spark: SparkSession, state: str, vocab: DataFrame, unk_id: int | None = None, version: int | None = None) -> DataFrame:
    """`(token_id, cnt, part_no, first)` of a version, against any vocabulary; only distinct words meet it."""
    words = merged_words(spark, state, version)
    tokens = _with_ids(words.join(_word_ids(vocab), "word", "left"), unk_id)
    counts = tokens.groupBy("token_id").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("part_no", "first")).alias("f"))
    return counts.select("token_id", "cnt", "f.part_no", "f.first")
