"""Quality rules: what the counts of n-grams cost, and windows made of shorter ones."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality
from lexloom.llm.shared import bind

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_ngrams_are_counted_as_rows_with_one_row_a_bucket(spark, monkeypatch):
    texts = ["a b c", "a b", "", None, " \n", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    collected = []
    collect = type(docs).collect

    def noted(df):
        rows = collect(df)
        collected.append((df, rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", noted)
    ratios, rest = quality.fit_ratios(docs, F.col("doc_id") == 0, F.col("doc_id") % 3, 3)
    ((counts, rows),) = collected
    # Functions of arrays are not compiled: a lambda for every n-gram made up most of the query's CPU time.
    assert "lambda" not in counts._jdf.queryExecution().optimizedPlan().toString()
    # Words a, b, c, x and pairs a b, b c: texts of all parts hold a, b and a b, which have one row nevertheless.
    assert len(rows) == len({row["bucket"] for row in rows}) == 6
    assert len(ratios) == quality.BUCKETS and len(rest) == 3
    # The only trusted text is in part 0.
    assert set(rest[0]) == {0.0} and max(ratios) > 0 and rest[1] != rest[2]


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 7, 8, 9, 16])
def test_windows_of_any_size_against_plain_counts(spark, window):
    parts = [f"w{i % 13} v{i}" for i in range(12)]
    texts = [None, "", " \n", "a", "a a", "a " * 40, "a b " * 20, "a b c d e f g h " * 2, "a b c d e f g x a b c d e f g y", " ".join(parts * 2), " ".join(parts), "a b c d " * 3 + "e f g h " * 3 + "a b c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    hashes = quality.word_hashes(quality.words_of(F.col("text")))
    repeated = bind(hashes, lambda h: bind(quality.neighbours(h), lambda p: quality.repeated_words(h, p, window)))
    for row in docs.select("i", repeated.alias("n")).collect():
        words = WORD.findall(texts[row["i"]] or "")
        windows = [tuple(words[at : at + window]) for at in range(len(words) - window + 1)]
        counts = Counter(windows)
        assert row["n"] == len({j for at, w in enumerate(windows) if counts[w] > 1 for j in range(at, at + window)})
