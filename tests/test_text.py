"""Text of rows."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import WHITESPACE, stringify, strip
from lexloom.operators.lines import clean_lines, explode_lines
from lexloom.operators.text import extract_text, extract_text_columns


def texts(df):
    return [row["text"] for row in df.collect()]


MESSAGES = "messages array<struct<role:string,content:string>>"


def test_text_column_never_falls_through(spark):
    df = spark.createDataFrame([(None, [("user", "m")]), ("t", None)], f"text string, {MESSAGES}")
    assert texts(extract_text(df)) == ["", "t"]


def test_numeric_text_zero_is_empty(spark):
    assert texts(extract_text(spark.createDataFrame([(0,), (7,)], "text int"))) == ["", "7"]


def test_messages_print_nulls(spark):
    df = spark.createDataFrame(
        [([("user", "a"), ("assistant", None), (None, "")],), (None,), ([],)], MESSAGES
    )
    assert texts(extract_text(df)) == ["user: a\nassistant: None\nNone: ", "", ""]


def test_messages_without_a_field(spark):
    no_role = spark.createDataFrame([([("x",)],)], "messages array<struct<content:string>>")
    assert texts(extract_text(no_role)) == ["user: x"]
    no_content = spark.createDataFrame([([("r",)],)], "messages array<struct<role:string>>")
    assert texts(extract_text(no_content)) == ["r: "]
    with pytest.raises(TypeError):
        extract_text(spark.createDataFrame([("x",)], "messages string"))


def test_other_tables_join_all_values_in_schema_order(spark):
    df = spark.createDataFrame([("b", 1, None, True, [1, 2])], "z string, a int, n string, t boolean, l array<int>")
    assert texts(extract_text(df)) == ["b 1 None True [1,2]"]
    assert texts(extract_text(df, keep=["a"], columns=["z", "t"])) == ["b True"]


def test_render_messages_treats_empty_as_missing(spark):
    schema = "conversations array<struct<role:string,from:string,content:string,value:string>>"
    rows = [
        ("", "human", "", "v"),
        ("user", "x", "c", "v"),
        (None, None, None, None),
        None,
    ]
    df = spark.createDataFrame([(rows,), (None,), ([],)], schema)
    assert texts(extract_text_columns(df)) == ["human: v\nuser: c\nunknown: \nNone", "None", ""]


def test_render_other_values(spark):
    assert texts(extract_text_columns(spark.createDataFrame([("x",)], "messages string"))) == ["x"]
    df = spark.createDataFrame([(["a", None],)], "messages array<string>")
    assert texts(extract_text_columns(df)) == ["a\nNone"]


def test_preferred_columns_in_their_own_order(spark):
    df = spark.createDataFrame([("o", "i", None, "x")], "output string, instruction string, text string, input string")
    assert texts(extract_text_columns(df)) == ["None\ni\no"]
    assert texts(extract_text_columns(df, ["input", "absent"])) == ["x"]
    assert texts(extract_text_columns(df, ["absent"])) == ["o i None x"]
    assert texts(extract_text_columns(df, [])) == ["o i None x"]


def test_strip_as_python_does(spark):
    values = [WHITESPACE + "a b" + WHITESPACE, " x", "한글　", "", "​zero width stays​"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(strip(F.col("v")).alias("v"))
    assert [row["v"] for row in df.collect()] == [v.strip() for v in values]


def test_stringify_keeps_null_on_request(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(stringify(F.col("v"), df.schema["v"].dataType, None)).collect()[0][0] is None


def test_lines_as_python_splits_and_cleans_them(spark):
    text = "a\r\n # note\n\n b#c \x0b#x \x1fd\x85  \n#"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    lines = explode_lines(df, "text", keep=["id"])
    # A final line break opens one more, empty line here; cleaning drops it.
    assert [row["line"] for row in lines.orderBy("line_no").collect()] == text.splitlines()
    want = [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
    assert [row["line"] for row in clean_lines(lines, "line").orderBy("line_no").collect()] == want
