"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, new_folder
from lexloom.functions.chat import ChatOptions
from lexloom.functions.prunable import keep_rules
from lexloom.operators.lines import clean_lines, explode_lines
from lexloom.operators.order import dedupe_keep_first, draw_rows, head_rows, sample_rows, with_row_keys
from lexloom.operators.pieces import count_pieces, segment_words
from lexloom.operators.text import extract_text, extract_text_columns
from lexloom.operators.tokens import (
    count_corpus,
    count_tokens,
    count_words,
    effective_max_length,
    first_tokens,
    rare_tokens,
    tokenize,
    top_tokens,
    usage_summary,
)
from lexloom.operators.unify import (
    chat_from_alpaca,
    chat_from_qa,
    chat_from_sharegpt,
    explode_messages,
    pad_union,
    tag_source,
    unify_by_source,
    unify_tables,
)
from lexloom.operators.vocab import label_vocab, prunable, unused_tokens, used_tokens, with_token_text
from lexloom.plans.effects import apply_changes, changed_rows, count_changes, index_words
from lexloom.plans.eviction import evict, eviction_stats, materialized_counts, select_evicted
from lexloom.plans.growing import merged_counts, update_counts
from lexloom.plans.profiles import profile_lines
from lexloom.plans.states import adapt_vocab, incoming_words, pair_tokens
from lexloom.plans.unified import unify_lazily, unify_sources
from lexloom.plans.usage import report_lines, report_usage, summarize_usage
from lexloom.schemas import ALPACA_SOURCE, QA_SOURCE, SHAREGPT_SOURCE
from lexloom.sinks import write_result
from lexloom.sources.corpus import SourceSpec, read_corpus, read_vocab
from workload.inputs import (
    CONVERSATION_ORDER,
    DOCUMENT_ORDER,
    ROW_ORDER,
    UNIFIED_ORDER,
    UNK_ID,
    alpaca_rows,
    build_vocabulary,
    conversations,
    documents,
    qa_rows,
    sharegpt_rows,
    spread,
    table,
    transcripts,
    untransformed_rows,
    vocabulary,
    vocabulary_file,
)

Query = Callable[[SparkSession, str], DataFrame]

PLAIN_PROMPT = "Answer briefly."
TRUNCATED_LENGTH = 2_048
DOCUMENT_RATIO = 0.5
SUMMARY_TOP_K = 200
REPORT_ROWS = 30
HEAD_ROWS = 100
PROFILED = {
    "benchmark": "item_id",
    "conversations": "conv_id, turn",
    "customer": "c_custkey",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "events": "event_id",
    "labels": "doc_id",
    "lineitem": "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice",
    "nation": "n_nationkey",
    "orders": "o_orderkey",
    "pages": "page_id",
    "part": "p_partkey",
    "region": "r_regionkey",
    "supplier": "s_suppkey",
}
# A table that is not there, and one whose splits are the languages of documents.
MISSING_TABLE, SPLIT_TABLE = "missing", "documents_by_lang"

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


@cache
def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _flat_counts(counts: DataFrame, *names: str) -> DataFrame:
    seen = [F.col(f"first_seen.{name}").alias(f"first_{name}") for name in (*names, "pos")]
    return counts.select("token_id", "cnt", *seen)


def _conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_corpus(
        extract_text(conversations(spark, sf_dir), keep=CONVERSATION_ORDER),
        vocabulary(spark, sf_dir),
        CONVERSATION_ORDER,
        unk_id=UNK_ID,
    )


def _plain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts without first occurrences, for what does not rank them."""
    rows = extract_text(conversations(spark, sf_dir))
    return count_corpus(rows, vocabulary(spark, sf_dir), None, unk_id=UNK_ID)


def _written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized_counts(
        conversations(spark, sf_dir), vocabulary(spark, sf_dir), CONVERSATION_ORDER, unk_id=UNK_ID
    )


# Unification


@query
def chat_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_messages(chat_from_alpaca(alpaca_rows(spark, sf_dir), keep=ROW_ORDER), keep=ROW_ORDER)


@query
def chat_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_messages(chat_from_sharegpt(sharegpt_rows(spark, sf_dir), keep=ROW_ORDER), keep=ROW_ORDER)


@query
def chat_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ChatOptions(system_prompt=PLAIN_PROMPT)
    return explode_messages(chat_from_qa(qa_rows(spark, sf_dir), options, keep=ROW_ORDER), keep=ROW_ORDER)


def _sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [
        (ALPACA_SOURCE, alpaca_rows(spark, sf_dir)),
        (SHAREGPT_SOURCE, sharegpt_rows(spark, sf_dir)),
        (QA_SOURCE, qa_rows(spark, sf_dir)),
    ]


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_tables(_sources(spark, sf_dir), ROW_ORDER)


@query
def unified_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_messages(_unified(spark, sf_dir), keep=UNIFIED_ORDER)


def _mixed(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [*_sources(spark, sf_dir), *untransformed_rows(spark, sf_dir)]


@query
def unified_lazily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_messages(unify_lazily(_mixed(spark, sf_dir), keep=ROW_ORDER), keep=ROW_ORDER)


@query
def unified_unknown_as_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pad_union([tag_source(df, name) for name, df in _mixed(spark, sf_dir)])
    return explode_messages(unify_by_source(mixed, ChatOptions(), unknown="qa", keep=ROW_ORDER), keep=ROW_ORDER)


@query
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_row_keys(_unified(spark, sf_dir), UNIFIED_ORDER)
    return keyed.select("row_key", "source", *ROW_ORDER, F.size("messages").alias("messages"))


# Text of rows


@query
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_unified(spark, sf_dir), keep=UNIFIED_ORDER)


@query
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pad_union([tag_source(df, name) for name, df in _sources(spark, sf_dir)])
    return extract_text_columns(mixed, keep=["source", *ROW_ORDER])


@query
def fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "part"), keep=["p_partkey"])


# Tokens and counts


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_words(documents(spark, sf_dir))


@query
def vocabulary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_vocabulary(spark, sf_dir)


@query
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(conversations(spark, sf_dir), keep=CONVERSATION_ORDER)
    return tokenize(rows, vocabulary(spark, sf_dir), CONVERSATION_ORDER, unk_id=UNK_ID)


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_counts(_conversation_counts(spark, sf_dir), *CONVERSATION_ORDER)


@query
def document_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(documents(spark, sf_dir), keep=DOCUMENT_ORDER)
    counts = count_corpus(rows, vocabulary(spark, sf_dir), DOCUMENT_ORDER, unk_id=UNK_ID)
    return _flat_counts(counts, *DOCUMENT_ORDER)


@query
def unified_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(_unified(spark, sf_dir), keep=UNIFIED_ORDER)
    counts = count_corpus(rows, vocabulary(spark, sf_dir), UNIFIED_ORDER, unk_id=UNK_ID)
    seen = F.col("first_seen")
    row_no = seen["row_order"] * (1 << 20) + seen["sub_order"]
    return counts.select(
        "token_id",
        "cnt",
        seen["source_order"].alias("first_source_order"),
        row_no.alias("first_row_no"),
        seen["pos"].alias("first_pos"),
    )


@query
def truncated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(documents(spark, sf_dir), keep=DOCUMENT_ORDER)
    length = effective_max_length(F.lit(1_000_000), F.lit(TRUNCATED_LENGTH))
    counts = count_corpus(rows, vocabulary(spark, sf_dir), DOCUMENT_ORDER, max_length=length, unk_id=UNK_ID)
    return _flat_counts(counts, *DOCUMENT_ORDER)


@query
def text_columns_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text_columns(alpaca_rows(spark, sf_dir), keep=ROW_ORDER)
    return _flat_counts(count_corpus(rows, vocabulary(spark, sf_dir), ROW_ORDER, unk_id=UNK_ID), *ROW_ORDER)


@query
def transcript_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(transcripts(spark, sf_dir), keep=["conv_id"])
    return _flat_counts(count_corpus(rows, vocabulary(spark, sf_dir), ["conv_id"], unk_id=UNK_ID), "conv_id")


# With a vocabulary from a file


@query
def tokenizer_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_file(spark, sf_dir)


@query
def tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(conversations(spark, sf_dir), keep=CONVERSATION_ORDER)
    occurrences = tokenize(rows, vocabulary_file(spark, sf_dir), CONVERSATION_ORDER, unk_id=UNK_ID)
    return _flat_counts(count_tokens(occurrences, CONVERSATION_ORDER), *CONVERSATION_ORDER)


def _file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(conversations(spark, sf_dir), keep=CONVERSATION_ORDER)
    return count_corpus(rows, vocabulary_file(spark, sf_dir), CONVERSATION_ORDER, unk_id=UNK_ID)


@query
def tokenizer_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_counts(_file_counts(spark, sf_dir), *CONVERSATION_ORDER)


@query
def tokenizer_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    evicted_rows = select_evicted(vocabulary_file(spark, sf_dir), _file_counts(spark, sf_dir))
    return evicted_rows.select("token_id", "token")


@query
def top_tokens_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_tokens(_conversation_counts(spark, sf_dir), SUMMARY_TOP_K)
    return with_token_text(top, vocabulary(spark, sf_dir)).select("rank", "token_id", "token", "cnt")


@query
def rare_tokens_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = rare_tokens(_conversation_counts(spark, sf_dir), REPORT_ROWS)
    return with_token_text(rare, vocabulary(spark, sf_dir)).select("rank", "token_id", "token", "cnt")


@query
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_summary(_plain_counts(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_usage(
        conversations(spark, sf_dir), vocabulary(spark, sf_dir), CONVERSATION_ORDER, n=REPORT_ROWS, unk_id=UNK_ID
    )


@query
def usage_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir)
    shown = F.coalesce("token_id", F.lit(-1)), F.coalesce("token", F.lit(""))
    return report.withColumns({"token_id": shown[0], "token": shown[1]})


@query
def usage_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_lines(_report(spark, sf_dir))


@query
def usage_summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = summarize_usage(
        conversations(spark, sf_dir),
        vocabulary(spark, sf_dir),
        CONVERSATION_ORDER,
        unk_id=UNK_ID,
        config={"dataset": "conversations", "split": "train", "model": "words"},
    )
    return document.select(
        F.col("config.dataset").alias("dataset"),
        F.col("config.split").alias("split"),
        F.col("config.model").alias("model"),
        F.coalesce("config.sample_limit", F.lit(-1)).alias("sample_limit"),
        F.array_join("config.text_columns", ",").alias("text_columns"),
        F.col("config.top_k").alias("top_k"),
        "summary.unique_token_count",
        "summary.total_token_count",
        F.posexplode("top_tokens").alias("pos", "entry"),
    ).select("*", "entry.token_id", "entry.token", F.col("entry.count").alias("cnt")).drop("entry")


# Vocabulary


@query
def vocabulary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(spark, sf_dir)
    rules = keep_rules(F.col("token"), F.col("is_special"))
    return vocab.select("token_id", *[rule.alias(name) for name, rule in rules.items()])


@query
def prunable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prunable(vocabulary(spark, sf_dir)).select("token_id", "token")


@query
def unused_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _plain_counts(spark, sf_dir)
    return unused_tokens(vocabulary(spark, sf_dir), counts).select("token_id", "token")


@query
def unused_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _plain_counts(spark, sf_dir)
    return unused_tokens(vocabulary(spark, sf_dir), counts, prunable_only=True).select("token_id", "token")


@query
def first_unused_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _plain_counts(spark, sf_dir)
    unused = unused_tokens(vocabulary(spark, sf_dir), counts, prunable_only=True)
    return first_tokens(unused, REPORT_ROWS).select("rank", "token_id", "token")


@query
def used_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _plain_counts(spark, sf_dir)
    return used_tokens(vocabulary(spark, sf_dir), counts, prunable_only=True).select("token_id", "cnt")


@query
def evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evict(conversations(spark, sf_dir), vocabulary(spark, sf_dir), CONVERSATION_ORDER, unk_id=UNK_ID)


@query
def evicted_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evict(
        documents(spark, sf_dir),
        vocabulary(spark, sf_dir),
        DOCUMENT_ORDER,
        ratio=DOCUMENT_RATIO,
        max_length=TRUNCATED_LENGTH,
        unk_id=UNK_ID,
    )


@query
def eviction_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _written_counts(spark, sf_dir)
    return eviction_stats(conversations(spark, sf_dir), vocabulary(spark, sf_dir), counts)


@query
def labelled_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(spark, sf_dir)
    return label_vocab(vocab, select_evicted(vocab, _conversation_counts(spark, sf_dir)))


# Tables


@query
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_rows(table(spark, sf_dir, "conversations"), CONVERSATION_ORDER, HEAD_ROWS)


@query
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "documents"), DOCUMENT_ORDER).select("doc_id", "lang", "n_chars")


@query
def drawn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_rows(table(spark, sf_dir, "documents"), DOCUMENT_ORDER).select("draw", "row_no", "doc_id", "lang")


@query
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(spark, sf_dir)
    words = count_words(extract_text(conversations(spark, sf_dir)))
    return segment_words(words.join(vocab, F.col("word") == F.col("token"), "left_anti"), vocab, UNK_ID)


@query
def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(extract_text(conversations(spark, sf_dir)), vocabulary(spark, sf_dir), UNK_ID)


@query
def grown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents and conversations: documents and pages come first, then conversations, and pages go."""

    def part(name: str, text: str, *order: str) -> DataFrame:
        a, b = [F.col(n) for n in order] if len(order) > 1 else [F.col(order[0]), F.lit(0)]
        return spread(table(spark, sf_dir, name), *order).select(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), F.col(text).alias("text"))

    state, order = new_folder(spark), ["a", "b"]
    docs = part("documents", "text", "doc_id")
    update_counts(spark, state, {"documents": docs, "pages": part("pages", "html", "page_id")}, order=order)
    update_counts(spark, state, {"documents": docs, "conversations": part("conversations", "text", "conv_id", "turn")}, ["pages"], order)
    counts = merged_counts(spark, state, vocabulary(spark, sf_dir), UNK_ID)
    places = [F.col("first")[i].alias(name) for i, name in enumerate((*order, "pos"))]
    return counts.select("token_id", "cnt", "part_no", *places)


@query
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedupe_keep_first(table(spark, sf_dir, "documents"), ["text"], DOCUMENT_ORDER)
    return kept.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(explode_lines(documents(spark, sf_dir), "text", keep=DOCUMENT_ORDER), "line")


@query
def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: f"{sf_dir}/{name}.parquet" for name in PROFILED} | {MISSING_TABLE: f"{sf_dir}/missing.parquet"}
    by_lang = table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")
    order = {name: key.split(", ") for name, key in PROFILED.items()} | {SPLIT_TABLE: DOCUMENT_ORDER}
    # Engines print floats in different ways, so vectors are shown in thousandths.
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", thousandths)
    lines = profile_lines(spark, tables | {SPLIT_TABLE: by_lang, "embeddings": vectors}, order=order)
    # What an error says differs between engines and folders.
    return lines.withColumn("line", F.when(F.col("name") == MISSING_TABLE, "cannot be read").otherwise(F.col("line")))


# Files


def _by_split(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark)
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")
    docs.write.partitionBy("split").parquet(path)
    return path


@query
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _by_split(spark, sf_dir)
    one = read_corpus(spark, path, split="de").select("doc_id", F.lit("de").alias("split"), F.md5("text").alias("text_md5"))
    everything = read_corpus(spark, path).select("doc_id", "split", F.md5("text").alias("text_md5"))
    return one.withColumn("read", F.lit("one")).unionByName(everything.withColumn("read", F.lit("all")))


@query
def vocabulary_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_result(vocabulary(spark, sf_dir), path, "parquet")
    return read_vocab(spark, path)


@query
def unified_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = []
    for name, df in _sources(spark, sf_dir):
        path = new_folder(spark)
        df.withColumnsRenamed({"row_order": "row_id", "sub_order": "sub_id"}).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(path)
        specs.append(SourceSpec(name, path, split="train", order={"row_id": "row_order", "sub_id": "sub_order"}))
    return explode_messages(unify_sources(spark, specs, ROW_ORDER), keep=UNIFIED_ORDER)


@query
def results_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_result(evicted(spark, sf_dir), path, "orc", order=["token_id"])
    return read_corpus(spark, path, fmt="orc")


@query
def profiles_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_result(table_profiles(spark, sf_dir), path, "csv")
    return read_corpus(spark, path, fmt="csv", schema="name string, part string, pos int, line string")


# What happens to the ids that are given up


@query
def incoming_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return incoming_words(pages, vocabulary(spark, sf_dir), ["page_id"]).select("rank", "token", "cnt")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_tokens(evicted(spark, sf_dir), incoming_tokens(spark, sf_dir))


@query
def paired_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir)


@query
def adapted_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_vocab(vocabulary(spark, sf_dir), _paired(spark, sf_dir))


def _effect_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, the vocabulary, and the vocabulary after the adaptation to them."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    return pages, vocabulary(spark, sf_dir), materialize(adapted_vocabulary(spark, sf_dir))


@query
def adaptation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, before, after = _effect_inputs(spark, sf_dir)
    return count_changes(index_words(pages, ["page_id"]), before, after, ["page_id"], UNK_ID)


@query
def adapted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts before and their changes; the SQL counts everything again."""
    pages, before, after = _effect_inputs(spark, sf_dir)
    changes = count_changes(index_words(pages, ["page_id"]), before, after, ["page_id"], UNK_ID)
    return apply_changes(count_corpus(pages, before, None, unk_id=UNK_ID), changes)


@query
def adapted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, before, after = _effect_inputs(spark, sf_dir)
    return changed_rows(index_words(pages, ["page_id"]), before, after, ["page_id"])
