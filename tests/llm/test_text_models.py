"""Backoff model, quality rules and language identification."""

import math
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from brute_katz import Katz, tokens, trains
from pyspark.sql import functions as F

from lexloom.llm import katz, language, quality, queries

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check_scores(found, docs, order):
    model = Katz([t for k, t in docs if trains(k)], order)
    n, v = sum(model.counts[1].values()), len(model.counts[1])
    want, got = [], []
    for key, text in docs:
        counts = [model.counts[1][(w,)] for w in tokens(text)]
        base = math.fsum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts)
        want.append((str(key), not trains(key), len(counts), sum(c > 0 for c in counts), n, base, model.score(text)))
    for r in found:
        got.append((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def test_backoff_query_against_dictionaries(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF_DIR, "documents").collect()]
    model = check_scores(queries.op2_katz(spark, SF_DIR).collect(), docs, 2)
    words = [*model.counts[1], (("unknown",),)]
    for gram in list(model.counts[2])[::4000]:
        assert sum(model.p(2, gram[:1] + w) for w in words) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_over_blocks_and_odd_rows(spark, order):
    docs = [(i, f"The cat{i % 5} sat on the mat {i % 3} and a Dog" * (i % 4)) for i in range(60)]
    docs += [(None, None), (100, ""), (101, " \n"), (7, "again the cat1"), (7, "again the cat1"), (102, "x " * 30_000), (103, "ÀÉ Àé"), (104, "w" * 500 + " a" * 3 + " \t" * 100 + "b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"key": F.lit(1), "train": F.lit("x"), "block": F.lit(2)})
    found = katz.score_documents(df, order=order, block_tokens=200, bucket_ngrams=20, part_bytes=50).collect()
    check_scores(found, docs, order)


def test_backoff_without_training_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    row = katz.score_documents(df, train=F.lit(False)).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)
    assert katz.score_documents(df.limit(0)).count() == 0


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def measures(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_quality_query_against_plain_measures(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF_DIR, "documents").collect()}
    rows = queries.op7_quality(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for row in rows:
        want = plain_measures(docs[row["doc_id"]])
        assert measures(row) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["kept"] and row["base_failed"])


def plain_buckets(text):
    def hashed(data, seed=42):
        return xxhash.xxh64(data, seed=seed).intdigest()

    words = [hashed(w.encode()) for w in WORD.findall(text or "")]
    pairs = [hashed(struct.pack("<Q", b), hashed(struct.pack("<Q", a))) for a, b in zip(words, words[1:])]
    return [h % quality.BUCKETS for h in words + pairs]


def plain_ratios(docs, good):
    raw, target = Counter(), Counter()
    for key, found in docs.items():
        raw.update(found)
        target.update(found if key in good else ())
    if not target:
        return [0.0] * quality.BUCKETS
    n, m = (sum(c.values()) + 0.5 * quality.BUCKETS for c in (raw, target))
    return [math.log((target[b] + 0.5) / m) - math.log((raw[b] + 0.5) / n) for b in range(quality.BUCKETS)]


def plain_cut(good, bad):
    """The middle of the first run of bins, each tried as the lowest kept one, that make the fewest errors."""
    good, bad = ([math.floor(s * quality.BINS) for s in scores] for scores in (good, bad))
    tried = range(min(good + bad), max(good + bad) + 2)
    errors = [sum(g < at for g in good) / len(good) + sum(b >= at for b in bad) / len(bad) for at in tried]
    first = last = errors.index(min(errors))
    while last + 1 < len(errors) and errors[last + 1] == errors[first]:
        last += 1
    return (tried[first] + tried[last]) / 2 / quality.BINS


def test_quality_verdicts_against_plain_model(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: plain_buckets(r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()}
    labels = {r["doc_id"]: r for r in queries.table(spark, sf_dir, "labels").collect() if r["quality"] is not None}
    good = {k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] != 1}
    bad = {k for k, r in labels.items() if r["quality"] != 1}
    parts = {k: zlib.crc32(str(k).encode()) % quality.FOLDS for k in docs}
    ratios = plain_ratios(docs, good)
    rest = [plain_ratios({k: b for k, b in docs.items() if parts[k] != p}, good) for p in range(quality.FOLDS)]
    score = {k: sum(ratios[b] for b in found) / max(1, len(found)) for k, found in docs.items()}
    held = {k: sum(rest[parts[k]][b] for b in found) / max(1, len(found)) for k, found in docs.items()}
    rows = queries.op7_quality(spark, sf_dir).collect()
    passed = {r["doc_id"] for r in rows if not r["base_failed"]}
    cut = plain_cut([held[k] for k in good & passed], [held[k] for k in bad & passed])
    assert len(rows) == len(docs) and good & passed and bad & passed
    for r in rows:
        assert r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-9)
        assert r["held_out_score"] == pytest.approx(held[r["doc_id"]], abs=1e-9)
        assert r["kept"] == (r["doc_id"] in passed and score[r["doc_id"]] >= cut)


def test_quality_of_labelled_documents(spark):
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    sums = {r["quality"]: r for r in rows.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert sums[1]["kept"] > 0.99 and sums[0]["kept"] < 0.3


def test_quality_of_labelled_documents_in_a_larger_table(spark):
    rows = queries.op7_quality(spark, "/root/testdata/sf0.1").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    shares = rows.where("NOT base_failed").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in shares.collect()}
    assert kept[1, 0] > 0.99 and kept[0, 0] < 0.05 and kept[0, 1] < 0.05


def test_cut_between_classes():
    # The lowest hump of bad texts would pull a midpoint of means below the other one.
    assert quality.best_cut([(-1400, 0, 60), (-200, 0, 40), (-60, 1, 0), (20, 99, 1)]) * quality.BINS == (-199 - 60) / 2
    assert quality.best_cut([(0, 5, 0)]) is None and quality.best_cut([]) is None
    assert quality.best_cut([(3, 2, 2)]) * quality.BINS == 3


def test_quality_of_odd_rows(spark):
    texts = [None, "", "   \n\t", "a " * 9, "a b c d e f g h " * 3 + "z", "x\n\nx\ny\n \n \nx", "|<>#*$%&", "w" * 100_000, "é ü " * 40, " ".join(map(str, range(5000)))]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b"), (4, texts[4])], "doc_id bigint, text string").withColumns({"score": F.lit("x"), "_key": F.lit(1)})
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, None), (9, 0, 0), (None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == 12
    for row in rows:
        text = "a b" if row["doc_id"] is None else texts[row["doc_id"]]
        assert measures(row) == plain_measures(text)
    assert quality.judge(docs, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_ratios_favour_trusted_text(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 10) for i in range(20)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    scores = {r["doc_id"] % 2: r["score"] for r in quality.judge(docs, labels).collect()}
    assert scores[1] > 0 > scores[0]


def test_language_held_out(spark):
    rows = queries.op8_language(spark, "/root/testdata/sf0.01")
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    held = rows.join(docs, "doc_id").where("held_out")
    assert held.count() > 100
    assert held.where("lang = lang_pred").count() / held.count() > 0.98
    assert rows.where("score < 0 OR score > 1").count() == 0 and rows.count() == docs.count()


def test_language_of_odd_rows(spark):
    texts = [("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !? % ² ① Ⅷ"[:13], None), (103, "the " * 500_000, None), (104, "der", None), (None, "the", None), (0, "the cat", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumns({"p": F.lit(1), "score": F.lit("s"), "row": F.lit(0)})
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df).collect()]
    assert len(found) == len(rows) + len(odd)
    named = {k: (lang, score) for k, lang, score in found}
    assert named[100] == named[101] == named[102] == ("und", 0.0)
    assert named[103][0] == "en" and named[104][0] == "de" and named[None][0] == "en"
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {100, 101, 102}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(nothing).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_long_texts_count_every_ngram_once():
    import numpy as np

    text = "abc déf gh " * 300
    for order in language.ORDERS:
        sums = []
        for size in (50, 1 << 20):
            total = np.zeros(65, np.int64)
            for _, points, starts in language.blocks([text, "x", text], size):
                total += np.bincount(language.buckets(points, order, 64, starts, size), minlength=65)
            sums.append(total[:64])
        assert (sums[0] == sums[1]).all()
