"""Reading and writing."""

import pytest

from lexloom.operators.lines import clean_lines
from lexloom.sinks import write_result
from lexloom.sources.corpus import read_corpus, read_lines, read_vocab
from workload.inputs import spread


@pytest.mark.parametrize("fmt", ["json", "parquet", "orc", "csv"])
def test_results_come_back_in_order(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    df = spark.createDataFrame([(i, f'w "{i}",\n{i}') for i in range(50, 0, -1)], "token_id int, token string")
    write_result(df.repartition(4), path, fmt, order=["token_id"])
    back = read_corpus(spark, path, fmt=fmt, schema="token_id int, token string")
    assert [tuple(r) for r in back.collect()] == [(i, f'w "{i}",\n{i}') for i in range(1, 51)]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        write_result(df, path, fmt)
    write_result(df.limit(1), path, fmt, mode="overwrite")
    assert read_corpus(spark, path, fmt=fmt, schema="token_id int, token string").count() == 1


def test_unknown_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        write_result(spark.range(1), str(tmp_path / "x"), "toml")
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path), fmt="toml")


def test_splits_prune_the_scan(spark, tmp_path):
    path = str(tmp_path / "corpus")
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "c")], "split string, text string")
    df.write.partitionBy("split").parquet(path)
    assert {tuple(r) for r in read_corpus(spark, path).select("split", "text").collect()} == set(
        map(tuple, df.collect())
    )
    train = read_corpus(spark, path, split="train")
    assert train.columns == ["text"] and train.count() == 2
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    spark.range(1).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "plain"), split="train")


@pytest.mark.parametrize("fmt", ["json", "parquet", "csv"])
def test_vocabulary_types(spark, tmp_path, fmt):
    rows = [(0, "<s>", True), (1, " the", False), (2, "한", False)]
    df = spark.createDataFrame(rows, "token_id bigint, token string, is_special boolean")
    path = str(tmp_path / fmt)
    writer = df.write.format(fmt).option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).save(path)
    vocab = read_vocab(spark, path, fmt)
    assert vocab.dtypes == [("token_id", "int"), ("token", "string"), ("is_special", "boolean")]
    assert sorted(map(tuple, vocab.collect())) == rows


def test_name_list(spark, tmp_path):
    (tmp_path / "names.txt").write_text("one\n\n  # note\n two \none\n", encoding="utf-8")
    lines = clean_lines(read_lines(spark, str(tmp_path / "names.txt")))
    assert sorted(r["value"] for r in lines.collect()) == ["one", "one", "two"]


def test_spread_only_below_the_number_of_cores(spark, tmp_path):
    spark.range(100).repartition(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread(many, "id") is many
