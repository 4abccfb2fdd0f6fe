"""Source shapes, the registry and both unifications, on rows the driver's tables do not have."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions.chat import ChatOptions
from lexloom.operators import unify
from lexloom.operators.order import with_row_keys
from lexloom.plans.unified import unify_lazily, unify_sources
from lexloom.schemas import ALPACA_SOURCE, QA_SOURCE, SHAREGPT_SOURCE, SYSTEM_PROMPT, UNIFIED_SCHEMA
from lexloom.sources.corpus import SourceSpec

SYSTEM = ("system", SYSTEM_PROMPT)


def messages(df):
    return [[tuple(m) for m in row["messages"]] for row in df.collect()]


def sharegpt(spark, *conversations):
    return spark.createDataFrame(
        [(c,) for c in conversations], "conversations array<struct<from:string,value:string>>"
    )


def test_alpaca_null_and_missing_differ(spark):
    df = spark.createDataFrame([("q", None), (None, "a")], "instruction string, output string")
    assert messages(unify.chat_from_alpaca(df)) == [
        [SYSTEM, ("user", "q"), ("assistant", "None")],
        [SYSTEM, ("user", "None"), ("assistant", "a")],
    ]
    assert messages(unify.chat_from_alpaca(df.drop("output")))[0][2] == ("assistant", "")
    assert messages(unify.chat_from_alpaca(df, ChatOptions(null_text="")))[0][2] == ("assistant", "")
    assert messages(unify.chat_from_alpaca(df, ChatOptions(null_text=None)))[0][2] == ("assistant", None)


def test_unified_schema_and_prompt(spark):
    df = spark.createDataFrame([(1, 2)], "input int, output int")
    unified = unify.chat_from_qa(df, ChatOptions(system_prompt="be brief"))
    assert [(f.name, f.dataType) for f in unified.schema] == [(f.name, f.dataType) for f in UNIFIED_SCHEMA]
    assert unified.collect()[0]["source"] == QA_SOURCE
    assert messages(unified) == [[("system", "be brief"), ("user", "1"), ("assistant", "2")]]


def test_sharegpt_roles_null_turns_and_null_conversations(spark):
    df = sharegpt(
        spark,
        [("human", "hi"), ("gpt", None), None, ("system", "s"), (None, "n")],
        None,
        [],
    )
    assert messages(unify.chat_from_sharegpt(df)) == [
        [SYSTEM, ("user", "hi"), ("assistant", "None"), ("assistant", "s"), ("assistant", "n")],
        [SYSTEM],
        [SYSTEM],
    ]
    kept = unify.chat_from_sharegpt(df, ChatOptions(turn_null_text=None))
    assert messages(kept)[0][2] == ("assistant", None)


def test_sharegpt_without_fields_or_column(spark):
    no_value = spark.createDataFrame([([("human",)],)], "conversations array<struct<from:string>>")
    assert messages(unify.chat_from_sharegpt(no_value)) == [[SYSTEM, ("user", "")]]
    no_from = spark.createDataFrame([([("x",)],)], "conversations array<struct<value:string>>")
    assert messages(unify.chat_from_sharegpt(no_from)) == [[SYSTEM, ("assistant", "x")]]
    assert messages(unify.chat_from_sharegpt(spark.range(1))) == [[SYSTEM]]
    with pytest.raises(TypeError):
        unify.chat_from_sharegpt(spark.createDataFrame([("x",)], "conversations string"))


def mixed(spark):
    alpaca = spark.createDataFrame([("q1", "a1")], "instruction string, output string")
    chats = sharegpt(spark, [("human", "h"), ("gpt", None)])
    qa = spark.createDataFrame([("q2", None)], "input string, output string")
    other = spark.createDataFrame([("in", "out")], "input string, output string")
    return [
        (ALPACA_SOURCE, alpaca),
        (SHAREGPT_SOURCE, chats),
        (QA_SOURCE, qa),
        ("other", other),
        ("", other),
        (None, other),
    ]


def test_lazy_unification_keeps_null_turns_and_handles_unknown_sources(spark):
    rows = unify_lazily(mixed(spark)).collect()
    got = {row["source"]: [tuple(m) for m in row["messages"]] for row in rows}
    assert got == {
        ALPACA_SOURCE: [SYSTEM, ("user", "q1"), ("assistant", "a1")],
        SHAREGPT_SOURCE: [SYSTEM, ("user", "h"), ("assistant", None)],
        QA_SOURCE: [SYSTEM, ("user", "q2"), ("assistant", "None")],
        "other": [SYSTEM],
        "unknown": [SYSTEM],
        "None": [SYSTEM],
    }


def test_unknown_source_as_question_and_answer(spark):
    df = unify.tag_source(spark.createDataFrame([("in", "out")], "input string, output string"), "other")
    assert messages(unify.unify_by_source(df, unknown="qa")) == [[SYSTEM, ("user", "in"), ("assistant", "out")]]
    assert messages(unify.unify_tables([("other", df)], [])) == [[SYSTEM, ("user", "in"), ("assistant", "out")]]
    with pytest.raises(ValueError):
        unify.unify_by_source(df, unknown="drop")


def test_missing_source_column(spark):
    row = unify.unify_by_source(spark.range(1)).collect()[0]
    assert row["source"] == "unknown" and len(row["messages"]) == 1


def test_registered_transform_is_dispatched_and_injects_its_source(spark):
    @unify.source_transform("made-up")
    def shout(df, options):
        return F.array(F.struct(F.lit("user").alias("role"), F.upper("text").alias("content")))

    try:
        df = spark.createDataFrame([("x",)], "text string")
        assert shout(df).collect()[0].asDict(True) == {
            "messages": [{"role": "user", "content": "X"}],
            "source": "made-up",
        }
        assert "made-up" in unify.registered_sources()
        assert messages(unify.unify_by_source(unify.tag_source(df, "made-up"))) == [[("user", "X")]]
    finally:
        del unify._BUILDERS["made-up"]


def test_sources_from_files_with_one_running_key(spark, tmp_path):
    alpaca = spark.createDataFrame(
        [(5, "train", "q1", "a1"), (2, "train", "q0", "a0"), (1, "test", "x", "y")],
        "id bigint, split string, instruction string, output string",
    )
    alpaca.write.partitionBy("split").parquet(str(tmp_path / "alpaca"))
    spark.createDataFrame([(7, "q2", "a2")], "n bigint, input string, output string").write.json(
        str(tmp_path / "qa")
    )
    specs = [
        SourceSpec(ALPACA_SOURCE, str(tmp_path / "alpaca"), split="train", order={"id": "row_order"}),
        SourceSpec(QA_SOURCE, str(tmp_path / "qa"), fmt="json", order={"n": "row_order"}),
    ]
    unified = unify_sources(spark, specs, ["row_order"])
    keyed = with_row_keys(unified, ["source_order", "row_order"]).orderBy("source_order", "row_order").collect()
    assert [(row["row_key"], row["messages"][1]["content"]) for row in keyed] == [
        (f"{ALPACA_SOURCE}-0", "q0"),
        (f"{ALPACA_SOURCE}-1", "q1"),
        (f"{QA_SOURCE}-2", "q2"),
    ]
