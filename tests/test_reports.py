"""Eviction, usage reports and table profiles."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.plans.eviction import evict, eviction_stats, materialized_counts, select_evicted
from lexloom.plans.profiles import explode_profiles, profile_lines, profile_tables
from lexloom.plans.states import adapt_vocab, incoming_words, pair_tokens
from lexloom.schemas import LOAD_FAILED, NO_SAMPLE
from lexloom.plans.usage import report_lines, report_usage, summarize_usage, usage_report

COUNTS = "token_id int, cnt bigint, first_seen struct<id:bigint,pos:int>"
# Odd ids may go, even ids are digits and stay.
TOKENS = {i: f"word{i}" if i % 2 else str(i) for i in range(1, 201)}


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(
        [(i, t, False) for i, t in TOKENS.items()], "token_id int, token string, is_special boolean"
    ).cache()


def two_stages(counts, ratio):
    """The unused by id, then the rarest used, chosen one after the other."""
    may_go = [i for i in TOKENS if i % 2]
    seen = {token: (n, first) for token, n, first in counts}
    target = max(1, int(len(may_go) * ratio))
    chosen = [i for i in may_go if i not in seen][:target]
    rarest = sorted((i for i in may_go if i in seen), key=lambda i: (-seen[i][0], seen[i][1]))[::-1]
    return sorted(chosen + rarest[: target - len(chosen)])


@pytest.mark.parametrize("seed", range(8))
def test_eviction_equals_two_stages(spark, vocab, seed):
    rng = random.Random(seed)
    used = rng.sample(sorted(TOKENS), rng.choice([0, 20, 150, 200]))
    positions = rng.sample(range(10_000), len(used))
    counts = [(token, rng.randint(1, 4), (p // 50, p % 50)) for token, p in zip(used, positions)]
    df = spark.createDataFrame(counts, COUNTS)
    ratio = [0.0, 0.29, 0.3, 0.5, 0.77, 0.9, 0.999, 1.0][seed]
    got = [r["token_id"] for r in select_evicted(vocab, df, ratio).collect()]
    assert got == two_stages(counts, ratio)


def test_quota_edges(spark, vocab):
    nothing = spark.createDataFrame([], COUNTS)
    # A hundred entries may go; 100 * 0.29 is just below 29 in double precision.
    for ratio, size in {0.0: 1, 0.29: 28, 1.0: 100}.items():
        assert select_evicted(vocab, nothing, ratio).count() == size
    keep_all = vocab.where("token_id % 2 = 0")
    assert select_evicted(keep_all, nothing, 0.5).isEmpty()
    for ratio in (-0.1, 1.1):
        with pytest.raises(ValueError):
            select_evicted(vocab, nothing, ratio)


CORPUS = [
    (1, "alpha beta beta gamma"),
    (2, "delta alpha beta 12"),
    (3, "epsilon gamma zeta"),
]
WORDS = ["<unk>", "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", " ", "1"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(
        [(i, w, i == 0) for i, w in enumerate(WORDS)], "token_id int, token string, is_special boolean"
    ).cache()


def test_evict_from_corpus(spark, corpus, words):
    # Eight words may go, half of them are taken: two unused ones, then the rarest, last seen first.
    got = [tuple(r) for r in evict(corpus, words, ["id"], ratio=0.5, unk_id=0).collect()]
    assert got == [(5, "epsilon"), (6, "zeta"), (7, "eta"), (8, "theta")]
    # Cut to three words, rows 1 and 3 lose their ends.
    got = [r["token"] for r in evict(corpus, words, ["id"], ratio=0.5, max_length=3, unk_id=0).collect()]
    assert got == ["gamma", "zeta", "eta", "theta"]


def test_eviction_numbers(spark, corpus, words):
    counts = materialized_counts(corpus, words, ["id"], unk_id=0)
    got = {r["metric"]: r["value"] for r in eviction_stats(corpus, words, counts, 0.5).collect()}
    assert got == {
        "vocab_tokens": 11,
        "prunable_tokens": 8,
        "unused_tokens": 2,
        "unused_prunable_tokens": 2,
        "quota": 4,
        "selected_unused": 2,
        "selected_rare": 2,
        "selected_total": 4,
        "corpus_rows": 3,
        "used_tokens": 9,
    }


def test_usage_report(spark, corpus, words):
    counts = materialized_counts(corpus, words, ["id"], unk_id=0)
    report = usage_report(counts, words, 3)
    rows = {}
    for r in report.orderBy("section", "rank").collect():
        rows.setdefault(r["section"], []).append((r["rank"], r["token_id"], r["token"], r["value"]))
    rare = [(1, 6, "zeta", 1), (2, 5, "epsilon", 1), (3, 0, "<unk>", 1)]
    assert rows == {
        "unused_count": [(0, None, None, 2)],
        "unused": [(1, 7, "eta", 0), (2, 8, "theta", 0)],
        "reassign_unused": [(1, 7, "eta", 0), (2, 8, "theta", 0)],
        "low_frequency": rare,
        "reassign_low_frequency": rare,
    }
    lines = [r["line"] for r in report_lines(report).orderBy("rank").collect()]
    assert lines[0] == "01. TOKEN_ID=6 | STR='zeta' | OCC=1"


def test_usage_report_of_first_rows(spark, corpus, words):
    report = report_usage(corpus, words, ["id"], limit=1, n=30, unk_id=0).collect()
    assert [r["value"] for r in report if r["section"] == "unused_count"] == [7]
    assert len([r for r in report if r["section"] == "low_frequency"]) == 4
    empty = report_usage(corpus, words, ["id"], limit=0, n=2, unk_id=0).collect()
    assert [r["value"] for r in empty if r["section"] == "unused_count"] == [11]


def test_usage_report_reads_all_rows_unless_told_otherwise(spark, words):
    many = spark.range(10_050).select("id", F.when(F.col("id") == 10_049, "theta").otherwise("alpha").alias("text"))
    report = report_usage(many, words, ["id"], unk_id=0).where("section = 'low_frequency'").collect()
    assert {r["token"]: r["value"] for r in report} == {"theta": 1, "alpha": 10_049}


def test_usage_document_can_be_written(spark, corpus, words, tmp_path):
    document = summarize_usage(corpus, words, ["id"], unk_id=0)
    for fmt in ("orc", "parquet", "json"):
        document.write.format(fmt).save(str(tmp_path / fmt))
    back = spark.read.orc(str(tmp_path / "orc"))
    assert back.select("config.sample_limit").dtypes == [("sample_limit", "bigint")] and back.collect() == document.collect()


def test_states_of_a_vocabulary(spark, corpus, words):
    other = spark.createDataFrame([(1, "new alpha new other"), (2, "third other eta")], "id bigint, text string")
    incoming = incoming_words(other, words, ["id"])
    assert [(r["rank"], r["token"], r["cnt"]) for r in incoming.orderBy("rank").collect()] == [(0, "new", 2), (1, "other", 2), (2, "third", 1)]
    gone = evict(corpus, words, ["id"], ratio=0.25, unk_id=0)
    pairs = pair_tokens(gone, incoming)
    assert sorted(map(tuple, pairs.collect())) == [(7, "eta", "new"), (8, "theta", "other")]
    adapted = {r["token_id"]: (r["token"], r["status"]) for r in adapt_vocab(words, pairs).collect()}
    assert adapted[7] == ("new", "injected") and adapted[1] == ("alpha", "kept") and len(adapted) == len(WORDS)


def test_usage_document(spark, corpus, words):
    config = {"dataset": "d", "split": "train", "model": "m"}
    row = summarize_usage(corpus, words, ["id"], limit=2, k=2, unk_id=0, config=config).collect()
    assert [r.asDict(recursive=True) for r in row] == [
        {
            "config": {
                **config,
                "text_columns": ["text", "messages", "conversations", "instruction", "output"],
                "sample_limit": 2,
                "top_k": 2,
            },
            "summary": {"unique_token_count": 7, "total_token_count": 15},
            "top_tokens": [
                {"token_id": 9, "token": " ", "count": 6},
                {"token_id": 2, "token": "beta", "count": 3},
            ],
        }
    ]
    nothing = summarize_usage(corpus, words, ["id"], limit=0).collect()[0]
    assert nothing["summary"]["total_token_count"] == 0 and nothing["top_tokens"] == []
    assert nothing["config"]["sample_limit"] == 0


def test_profiles(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", 2, "it's", [("user", "x")]), ("test", 1, 'a "b"\n', None)],
        "split string, id int, text string, messages array<struct<role:string,content:string>>",
    )
    df.write.partitionBy("split").parquet(str(tmp_path / "parts"))
    df.drop("split").where("id = 2").write.parquet(str(tmp_path / "plain"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    broken = spark.range(1).selectExpr("raise_error('no luck') AS value")
    tables = {
        "parts": str(tmp_path / "parts"),
        "absent": str(tmp_path / "absent"),
        "plain": str(tmp_path / "plain"),
        "empty": str(tmp_path / "empty"),
        "broken": broken,
        "no rows to split": df.limit(0),
    }
    rows = {r["name"]: r for r in profile_tables(spark, tables, order={"parts": ["id"]}).collect()}
    assert set(rows) == set(tables)
    schema = ["id: int", "text: string", "messages: array<struct<role:string,content:string>>"]
    assert rows["parts"][1:] == (["test", "train"], schema, ["id: 1", "text: 'a \"b\"\\n'", "messages: None"])
    assert rows["plain"][1:] == (
        ["single"],
        schema,
        ["id: 2", 'text: "it\'s"', 'messages: [{"role":"user","content":"x"}]'],
    )
    assert rows["empty"][1:] == (["single"], ["id: bigint"], [NO_SAMPLE])
    absent = rows["absent"]
    assert absent["splits"] is None and absent["schema"] == absent["sample"]
    assert absent["schema"][0].startswith(f"{LOAD_FAILED}: ") and "absent" in absent["schema"][0]
    assert rows["broken"]["splits"] is None and rows["broken"]["sample"][0].startswith(f"{LOAD_FAILED}: ")
    assert rows["no rows to split"][1:] == ([], [LOAD_FAILED], [LOAD_FAILED])
    plain = {"plain": tables["plain"]}
    long = explode_profiles(profile_tables(spark, plain))
    assert long.count() == 1 + 3 + 3 and long.exceptAll(profile_lines(spark, plain)).isEmpty()
