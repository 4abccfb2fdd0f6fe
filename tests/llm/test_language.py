"""Naive Bayes against a plain version, texts that no language knows, and several matrices."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import language, queries
from lexloom.llm.shared import fold

FOREIGN = [
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος",
    "素早い茶色の狐がのろまな犬を飛び越えて森の中へ走っていきました。",
    "Быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес.",
    "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie do lasu, gdzie mieszka jego rodzina.",
    "xq vjz kqpw zzx wqj vbk qxz jjq pzv kwx qvv zqk xjw",
]


def plain_grams(text):
    """Buckets of all n-grams, by whole numbers."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    points = [ord(c) for c in " ".join([""] + letters.split() + [""])] if letters.strip() else []
    wrap, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15
    for order in language.ORDERS:
        for at in range(len(points) - order + 1):
            code = 0
            for point in points[at : at + order]:
                code = ((code << 21) + point) & wrap
            hashed = ((((code ^ (code >> 29)) * mix + order) & wrap) * mix) & wrap
            yield hashed >> (64 - 15)


def plain_identify(rows):
    """`doc_id -> (lang, posterior)` by dictionaries."""
    import zlib

    held = {i for i, _, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0}
    train = [(t, lang) for i, t, lang in rows if i not in held and lang is not None]
    names = sorted({lang for _, lang in train})
    counts = {n: Counter(g for t, lang in train if lang == n and t for g in plain_grams(t)) for n in names}
    sizes = {n: sum(counts[n].values()) + language.SMOOTHING * language.BUCKETS for n in names}
    found = {}
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            found[i] = ("und", 0.0)
            continue
        scores = {
            n: math.log(sum(lang == n for _, lang in train) / len(train))
            + sum(math.log((counts[n][g] + language.SMOOTHING) / sizes[n]) for g in plain_grams(text))
            for n in names
        }
        best = max(names, key=scores.get)
        found[i] = (best, 1 / sum(math.exp(scores[n] - scores[best]) for n in names))
    return found


def test_against_plain_version(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    short = docs.withColumn("text", F.substring("text", 1, 400))
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "de"), (-3, "12 ²!", None), (-4, "la", None), (-5, "İstanbul ẞ", "de")], short.schema)
    df = short.union(odd)
    expected = plain_identify([tuple(r) for r in df.collect()])
    found = language.identify(df).collect()
    assert len(found) == len(expected)
    for row in found:
        lang, score = expected[row["doc_id"]]
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(score, abs=1e-9)


def test_unlearnt_languages_go_and_clean_documents_stay(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r["doc_id"]: r["lang"] for r in language.keep_identified(docs.union(foreign)).select("doc_id", "lang").collect()}
    assert not [i for i in kept if i < 0]
    labelled = docs.where("lang IS NOT NULL").collect()
    assert all(kept.get(r["doc_id"]) == r["lang"] for r in labelled)


def test_several_matrices_predict_as_one(spark, monkeypatch):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    one = language.identify(docs).collect()
    monkeypatch.setattr(language, "GROUP", 1)
    assert len(language.train(docs.where(fold(F.col("doc_id")) != 0))) > 1
    several = {r["doc_id"]: r for r in language.identify(docs).collect()}
    for row in one:
        other = several[row["doc_id"]]
        assert other["lang_pred"] == row["lang_pred"] and np.isclose(other["score"], row["score"])
