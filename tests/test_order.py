"""Numbering, first rows, samples and duplicates."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import order as o


def table(spark, n=500, seed=0, partitions=7):
    rng = random.Random(seed)
    ids = rng.sample(range(-10_000, 10_000), n)
    rows = [(rng.choice("abc"), i, f"text {i % 9}") for i in ids]
    df = spark.createDataFrame(rows, "source string, id bigint, text string").repartition(partitions)
    return df, sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_row_keys_run_over_all_sources(spark, partitions):
    df, rows = table(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = o.with_row_keys(df, ["source", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["row_key"]: (r["source"], r["id"], r["text"]) for r in keyed} == {
        f"{row[0]}-{i}": row for i, row in enumerate(rows)
    }


def test_numbering_in_any_sort_order_with_total(spark):
    df, rows = table(spark)
    numbered = o.number_rows(df, F.asc("text"), F.desc("id"), name="n", total="t").collect()
    want = sorted(rows, key=lambda r: (r[2], -r[1]))
    assert [(r["source"], r["id"], r["text"]) for r in sorted(numbered, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in numbered) == list(range(len(rows))) and {r["t"] for r in numbered} == {len(rows)}


def test_numbering_needs_keys_that_tell_rows_apart(spark):
    df, _ = table(spark)
    with pytest.raises(ValueError):
        o.with_row_keys(df, ["source"])
    nulls = spark.createDataFrame([("a", None), ("a", 1)], "source string, id bigint")
    with pytest.raises(ValueError):
        o.with_row_keys(nulls, ["source", "id"])
    assert o.with_row_keys(df.limit(0), ["source", "id"]).isEmpty()


@pytest.mark.parametrize("n", [None, 0, 1, 17, 499, 500, 900])
@pytest.mark.parametrize("few", [o.FEW_ROWS, 5])
def test_first_rows(spark, monkeypatch, n, few):
    monkeypatch.setattr(o, "FEW_ROWS", few)
    df, rows = table(spark)
    by_id = sorted(rows, key=lambda r: r[1])
    assert sorted(map(tuple, o.head_rows(df, ["id"], n).collect()), key=lambda r: r[1]) == by_id[:n]
    by_both = o.head_rows(df, ["source", "id"], n).collect()
    assert sorted(map(tuple, by_both), key=lambda r: (r[0], r[1])) == rows[:n]


def test_many_first_rows_without_a_task_that_sorts_all_keys(spark):
    df = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_003).alias("k"))
    numbered = o.number_rows(df, "k", name="n")
    assert numbered._jdf.queryExecution().executedPlan().toString().count("SinglePartition") <= 1
    head = o.head_rows(df, ["k"], 180_000)
    bound = head.agg(F.count(F.lit(1)), F.max("k"), F.count_distinct("k")).first()
    assert bound[0] == bound[2] == 180_000 and df.where(F.col("k") <= bound[1]).count() == 180_000
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("few", [o.FEW_ROWS, 2])
def test_first_rows_of_equal_and_null_keys(spark, monkeypatch, few):
    monkeypatch.setattr(o, "FEW_ROWS", few)
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 4), (1, 5), (2, 6)], "k int, v int")
    for n in range(1, 7):
        got = sorted((r["k"] is not None, r["k"] or 0) for r in o.head_rows(df, ["k"], n).collect())
        assert got == [(False, 0), (False, 0), (True, 1), (True, 1), (True, 1), (True, 2)][:n]
    assert {r["v"] for r in o.head_rows(df, ["k", "v"], 3).collect()} == {1, 2, 3}


def test_first_rows_reach_the_scan(spark, tmp_path):
    df, _ = table(spark)
    df.write.parquet(str(tmp_path / "t"))
    head = o.head_rows(spark.read.parquet(str(tmp_path / "t")), ["id"], 10)
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(id),LessThanOrEqual(id," in plan and "Exchange" not in plan


def test_sample_is_repeatable_at_any_partitioning(spark):
    df, _ = table(spark, partitions=1)
    wide, _ = table(spark, partitions=31)
    first = {r["id"] for r in o.sample_rows(df, ["id"], 12).collect()}
    assert len(first) == 12
    assert first == {r["id"] for r in o.sample_rows(wide, ["id"], 12).collect()}
    assert first != {r["id"] for r in o.sample_rows(df, ["id"], 12, seed=43).collect()}
    assert o.sample_rows(df, ["id"], 1000).count() == 500


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100, 1000])
def test_permutation_takes_every_number_once(spark, size):
    found = [r[0] for r in spark.range(size).select(o.permuted(F.col("id"), size)).collect()]
    assert sorted(found) == list(range(size))
    if size >= 64:
        assert found != sorted(found)
        assert found != [r[0] for r in spark.range(size).select(o.permuted(F.col("id"), size, seed=7)).collect()]


@pytest.mark.parametrize("broadcast", [0, o.BROADCAST_ROWS])
def test_drawn_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(o, "BROADCAST_ROWS", broadcast)
    rows = [("b" if i % 3 else "a", i) for i in range(50)]
    df = spark.createDataFrame(rows, "source string, id int").withColumn("draw_", F.lit(0))
    drawn = o.draw_rows(df, ["source", "id"], k=20).orderBy("draw").collect()
    places = {row: i for i, row in enumerate(sorted(rows))}
    assert [r["draw"] for r in drawn] == list(range(1, 21))
    assert all(places[r["source"], r["id"]] == r["row_no"] for r in drawn) and len({r["id"] for r in drawn}) == 20
    # Any partitioning draws the same rows, and more draws begin with the same.
    again = o.draw_rows(df.repartition(7), ["source", "id"], k=200).orderBy("draw").collect()
    assert len(again) == 50 and [r["id"] for r in again[:20]] == [r["id"] for r in drawn]
    assert o.draw_rows(df.limit(0), ["source", "id"]).isEmpty() and o.draw_rows(df, ["source", "id"], k=0).isEmpty()


def test_draw_from_few_rows(spark):
    df, rows = table(spark, n=2)
    assert o.draw_rows(df, ["source", "id"]).count() == 2
    assert o.draw_rows(df.limit(0), ["source", "id"]).isEmpty()


def test_dedupe_keeps_the_first_and_never_sorts_texts(spark):
    df, rows = table(spark)
    first = {}
    for row in sorted(rows, key=lambda r: r[1]):
        first.setdefault(row[2], row)
    kept = o.dedupe_keep_first(df, ["text"], ["id"])
    assert {tuple(r) for r in kept.collect()} == set(first.values())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Sort [text" not in plan and "hashpartitioning(text" not in plan


def test_dedupe_of_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), ("a", None, "y"), ("a", 1, "z"), ("a", None, "y"), ("null", 2, "w")], "k string, o int, v string")
    kept = o.dedupe_keep_first(df, ["k"], ["o"]).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, 1, "x"), ("a", None, "y"), ("null", 2, "w")]))
    assert o.dedupe_keep_first(df.limit(0), ["k"], ["o"]).isEmpty()


def test_materialized_tables_can_be_deleted(spark):
    from lexloom.checkpoints import materialize, release

    kept, gone = materialize(spark.range(5)), materialize(spark.range(7))
    release(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(gone._lexloom_path).count()
    assert o.number_rows(spark.range(3), "id").count() == 3


def test_checkpoint_folder_comes_from_the_session(spark):
    from lexloom.checkpoints import shared_folder

    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
