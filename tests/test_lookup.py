"""Looking up keyed tables of any size from rows with frequent and null keys."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import lookup


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 7 > 0, F.col("id")).cast("bigint").alias("k")
    )
    other = spark.createDataFrame([(1, "one", None), (None, "none", [1])], "k bigint, w string, v array<int>")
    table = spark.range(0, 2000, 2).select(
        F.col("id").alias("k"), (F.col("id") * 2).cast("string").alias("w"), F.array(F.col("id").cast("int")).alias("v")
    )
    return rows, table.unionByName(other).where("k IS NULL OR k != 0")


@pytest.mark.parametrize("hot_keys", [1, 1_000])
@pytest.mark.parametrize("limit", [1 << 30, -1], ids=["small", "large"])
def test_attach_agrees_with_a_join(spark, tables, monkeypatch, limit, hot_keys):
    monkeypatch.setattr(lookup, "HOT_KEYS", hot_keys)
    rows, table = tables
    expected = rows.join(table, "k", "left").select("id", "k", "w", "v")
    found = lookup.attach(rows, table, ["k"], ["id"], limit).select("id", "k", "w", "v")
    assert found.count() == 2000 and found.exceptAll(expected).isEmpty()


def test_two_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 1)], "id bigint, s string, n int")
    table = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0)], "s string, n int, x double")
    for limit in (1 << 20, -1):
        found = lookup.attach(rows, table, ["s", "n"], ["id"], limit)
        assert sorted((r["id"], r["x"]) for r in found.collect()) == [(1, 5.0), (2, None), (3, None)]
        assert lookup.attach(rows.limit(0), table, ["s", "n"], ["id"], limit).isEmpty()
        assert lookup.attach(rows, table.limit(0), ["s", "n"], ["id"], limit).where("x IS NOT NULL").isEmpty()


def test_size_is_measured(spark):
    small = spark.range(10).select("id", F.lit("x").alias("s"), F.array(F.lit(1.5)).alias("a"))
    assert 0 < lookup.table_bytes(small) < lookup.table_bytes(small.withColumn("s", F.repeat(F.lit("x"), 10_000)))
    assert lookup.table_bytes(small.limit(0)) == 0
