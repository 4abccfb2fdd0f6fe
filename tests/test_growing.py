"""Counts that grow, against a count of everything at once."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators.tokens import pretokenize
from lexloom.plans.growing import manifest, merged_counts, merged_words, update_counts, versions


def part(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string").withColumn("part", F.lit("x"))


def recount(parts):
    found = {}
    for number, rows in parts:
        for row_id, text in rows:
            for pos, word in enumerate(re.findall(r"\w+|\s+", text or "")):
                n, first = found.get(word, (0, None))
                place = (number, row_id is not None, row_id or 0, pos)
                found[word] = (n + 1, min(first or place, place))
    return {w: (n, first[0], [first[2] if first[1] else None, first[3]]) for w, (n, first) in found.items()}


def merged(spark, state, version=None):
    return {r["word"]: (r["cnt"], r["part_no"], list(r["first"])) for r in merged_words(spark, state, version).collect()}


def test_parts_come_and_go(spark, tmp_path):
    state = str(tmp_path / "state")
    a = [(1, "x y x"), (2, None), (3, "")]
    b = [(7, "z x"), (None, "y w"), (7, "z x")]
    c = [(0, "v x")]
    assert merged(spark, state) == {} and versions(spark, state) == []
    assert update_counts(spark, state, {"a": part(spark, a), "b": part(spark, b)}, order=["id"]) == 1
    assert merged(spark, state) == recount([(0, a), (1, b)])
    folders = {r["part"]: r["folder"] for r in manifest(spark, state).collect()}
    # The same content in another order is not counted again; changed content keeps its place.
    changed = [(1, "y q")]
    update_counts(spark, state, {"b": part(spark, b[::-1]).repartition(3), "a": part(spark, changed), "c": part(spark, c)}, order=["id"])
    later = {r["part"]: r["folder"] for r in manifest(spark, state).collect()}
    assert later["b"] == folders["b"] and later["a"] != folders["a"]
    assert merged(spark, state) == recount([(0, changed), (1, b), (2, c)])
    update_counts(spark, state, {"d": part(spark, c)}, withdraw=["c", "a"], order=["id"])
    assert merged(spark, state) == recount([(1, b), (3, c)])
    with pytest.raises(ValueError):
        update_counts(spark, state, withdraw=["nothing"], order=["id"])
    assert versions(spark, state) == [1, 2, 3]
    assert merged(spark, state, 1) == recount([(0, a), (1, b)])
    update_counts(spark, state, withdraw=["b", "d"], order=["id"])
    assert merged(spark, state) == {}


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    state = str(tmp_path / "state")
    update_counts(spark, state, {"a": part(spark, [(1, "x")])}, order=["id"])
    (tmp_path / "state" / "manifest" / "v=2").mkdir()
    (tmp_path / "state" / "manifest" / "v=2" / "part-0.json").write_text("{}")
    assert versions(spark, state) == [1] and merged(spark, state) == {"x": (1, 0, [1, 0])}
    assert update_counts(spark, state, {"b": part(spark, [(1, "x")])}, order=["id"]) == 2
    assert merged(spark, state)["x"][0] == 2


def test_merged_counts_by_id(spark, tmp_path):
    state = str(tmp_path / "state")
    rows = [(1, "a b a"), (2, "c d")]
    update_counts(spark, state, {"p": part(spark, rows)}, order=["id"])
    vocab = spark.createDataFrame([(5, "a", False), (6, "c", False)], "token_id int, token string, is_special boolean")
    found = {r["token_id"]: (r["cnt"], list(r["first"])) for r in merged_counts(spark, state, vocab, 0).collect()}
    # Blanks are words too.
    assert found == {5: (2, [1, 0]), 0: (5, [1, 1]), 6: (1, [2, 0])}
    assert sum(n for n, _ in found.values()) == pretokenize(part(spark, rows), ["id"]).count()
