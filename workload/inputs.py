"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, new_folder
from lexloom.operators.order import number_rows
from lexloom.operators.tokens import count_words
from lexloom.sinks import write_result
from lexloom.sources.corpus import read_corpus, read_vocab

CONVERSATION_ORDER = ["conv_id", "turn"]
DOCUMENT_ORDER = ["doc_id"]
ROW_ORDER = ["row_order", "sub_order"]
UNIFIED_ORDER = ["source_order", *ROW_ORDER]

SPECIAL_TOKENS = ("<|endoftext|>", "<unk>")
UNK_ID = 1

_vocabularies: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share out a scanned table that has fewer scan tasks than the session has cores.

    Splitting text into words takes far longer than reading it, so a small file must not stay in one task.
    A table of many files is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "conversations"), *CONVERSATION_ORDER)
    return df.withColumn("turn", F.col("turn").cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), *DOCUMENT_ORDER)


def build_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of `documents` by count, numbered after the two special tokens."""
    words = number_rows(count_words(documents(spark, sf_dir)), F.desc("cnt"), F.asc("word"), name="place")
    tokens = words.select(
        (F.col("place") + len(SPECIAL_TOKENS)).cast("int").alias("token_id"),
        F.col("word").alias("token"),
        F.lit(False).alias("is_special"),
    )
    specials = spark.range(len(SPECIAL_TOKENS)).select(
        F.col("id").cast("int").alias("token_id"),
        F.element_at(F.array(*[F.lit(t) for t in SPECIAL_TOKENS]), F.col("id").cast("int") + 1).alias("token"),
        F.lit(True).alias("is_special"),
    )
    return specials.unionByName(tokens)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary, written once per session and data folder as a tokenizer's vocabulary would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vocabularies:
        _vocabularies[key] = materialize(build_vocabulary(spark, sf_dir))
    return _vocabularies[key]


def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary as it comes back from a JSON file in the shared folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} as JSON")
    if key not in _vocabularies:
        path = new_folder(spark)
        write_result(vocabulary(spark, sf_dir), path, "json")
        _vocabularies[key] = read_vocab(spark, path, "json")
    return _vocabularies[key]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one row of messages, turns in order."""
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("message"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.col("turns.message").alias("messages"))


def alpaca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant's answer to it. Keys are unique on both sides."""
    turns = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("int"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("row_order"), F.col("turn").alias("sub_order"), "instruction", "output"
    )


def sharegpt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a conversation of its lines, in turn by a human, a model and a system."""
    speakers = F.array(F.lit("human"), F.lit("gpt"), F.lit("system"))
    turns = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(F.element_at(speakers, i % 3 + 1).alias("from"), line.alias("value")),
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_order"), F.lit(0).alias("sub_order"), turns.alias("conversations")
    )


def qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a question, its first line, and an answer, the rest."""
    first = F.substring_index("text", "\n", 1)
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_order"),
        F.lit(0).alias("sub_order"),
        first.alias("input"),
        F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("output"),
    )


def untransformed_rows(spark: SparkSession, sf_dir: str) -> list[tuple[str | None, DataFrame]]:
    """Tables of sources without a transform: one with a name, one with an empty and one with a null name."""
    benchmark = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_order"), F.lit(0).alias("sub_order"), F.col("text").alias("input")
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_order"), F.lit(0).alias("sub_order"))
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("row_order"),
        F.lit(0).alias("sub_order"),
        F.col("n_name").alias("output"),
    )
    return [("benchmark", benchmark), ("", labels), (None, nation)]
