"""The rules that keep vocabulary entries, rule by rule and over all code points."""

import sys

import pytest
from pyspark.sql import functions as F

from lexloom.functions.prunable import is_prunable, keep_rules
from lexloom.operators.vocab import prunable

KEPT = {
    "": "blank",
    "  　": "blank",
    "<0x0A>": "byte",
    "<0xfF>": "byte",
    "a\tb": "control",
    "line\n": "control",
    "\x1f": "control",
    "123": "digits",
    " 42 ": "digits",
    "10²": "digits",
    "!!": "symbols",
    "Привет": "symbols",
    "漢字かな": "symbols",
    "éà": "symbols",
    "Ġthe": "space_marker",
    "▁the": "space_marker",
    "ab": "short",
    " x": "short",
    "한글": "short",
    "7b": "short",
}
PRUNABLE = [" the", "한국어", "a!", "foo1", "<0x0A>x", "<0x0G>", "<0x0A>\x85", "caf\x7f", "a-", "1.5", "éab"]


def test_each_rule(spark):
    rows = [(token, False) for token in [*KEPT, *PRUNABLE]]
    df = spark.createDataFrame(rows, "token string, is_special boolean")
    rules = keep_rules(F.col("token"), F.col("is_special"))
    got = df.select("token", *[rule.alias(name) for name, rule in rules.items()]).collect()
    for row in got:
        hit = {name for name in rules if row[name]}
        if row["token"] in KEPT:
            assert KEPT[row["token"]] in hit, row
        else:
            assert not hit, row


def test_special_and_null_tokens_are_kept(spark):
    df = spark.createDataFrame(
        [(0, "<|endoftext|>", True), (1, "word", None), (2, None, False)],
        "token_id int, token string, is_special boolean",
    )
    assert [row["token_id"] for row in prunable(df).collect()] == [1]


@pytest.fixture(scope="module")
def characters(spark):
    """Every character with every rule, alone and after letters."""
    points = spark.range(sys.maxunicode + 1).where("id < 55296 OR id > 57343").select(F.col("id").cast("int"))
    chars = points.mapInPandas(
        lambda batches: (b.assign(token=[chr(i) for i in b["id"]]) for b in batches), "id int, token string"
    )
    rules = keep_rules(F.col("token"), F.lit(False))
    return chars.select("token", *[rule.alias(name) for name, rule in rules.items()]).toPandas()


def test_blank_digit_and_control_rules_agree_with_python_everywhere(characters):
    tokens = characters["token"]
    assert list(characters["control"]) == [ord(c) < 32 for c in tokens]
    free = ~characters["control"]
    assert list(characters["blank"][free]) == [c.isspace() for c in tokens[free]]
    assert list(characters["digits"]) == [c.isdigit() for c in tokens]


def test_short_rule_differs_from_python_only_in_scripts_that_stay_anyway(characters):
    differing = characters[[a != c.isalnum() for a, c in zip(characters["short"], characters["token"])]]
    assert differing["symbols"].all()


def test_prunable_needs_no_rule_to_hold(spark):
    df = spark.createDataFrame([(t,) for t in [*KEPT, *PRUNABLE]], "token string")
    got = {row["token"] for row in df.where(is_prunable(F.col("token"), F.lit(False))).collect()}
    assert got == set(PRUNABLE)
