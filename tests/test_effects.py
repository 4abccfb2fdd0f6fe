"""Effects of an adaptation, against counting everything again."""

import random
from collections import Counter

import pytest

from lexloom.operators.tokens import count_corpus
from lexloom.plans.effects import apply_changes, changed_rows, changed_words, count_changes, index_words

VOCAB = "token_id int, token string, is_special boolean"
ROWS = [(1, "a b a c"), (2, None), (3, ""), (4, "d d e"), (None, "e a"), (5, "b " * 3_000)]
BEFORE = [(0, "<unk>", True), (1, "a", False), (2, "b", False), (3, " ", False), (4, "a", False), (5, None, False), (6, "zz", False)]
AFTER = [(0, "<unk>", True), (1, "d", False), (2, "b", False), (3, " ", False), (4, "a", False), (5, None, False), (6, "e", False)]


def counted(df):
    return {r["token_id"]: r["cnt"] for r in df.collect()}


@pytest.mark.parametrize("unk_id", [0, None])
@pytest.mark.parametrize("broadcast", [True, False])
def test_changes_equal_a_recount(spark, monkeypatch, unk_id, broadcast):
    if not broadcast:
        monkeypatch.setattr("lexloom.plans.effects.BROADCAST_BYTES", 0)
    corpus = spark.createDataFrame(ROWS, "id bigint, text string")
    before, after = spark.createDataFrame(BEFORE, VOCAB), spark.createDataFrame(AFTER, VOCAB)
    index = index_words(corpus, ["id"])
    changes = count_changes(index, before, after, ["id"], unk_id)
    found = counted(apply_changes(count_corpus(corpus, before, None, unk_id=unk_id), changes))
    assert found == counted(count_corpus(corpus, after, None, unk_id=unk_id))
    assert {r["word"]: (r["id_before"], r["id_after"]) for r in changed_words(before, after).collect()} == {
        "a": (1, 4), "d": (None, 1), "e": (None, 6), "zz": (6, None),
    }
    rows = {r["id"]: tuple(r)[1:] for r in changed_rows(index, before, after, ["id"]).collect()}
    assert rows == {1: (2, 2, 2), 4: (3, 0, 3), None: (2, 1, 2)}


def test_nothing_changes(spark):
    corpus, vocab = spark.createDataFrame(ROWS, "id bigint, text string"), spark.createDataFrame(BEFORE, VOCAB)
    index = index_words(corpus, ["id"])
    assert count_changes(index, vocab, vocab, ["id"], 0).count() == 0 and changed_rows(index, vocab, vocab, ["id"]).count() == 0
    empty = index_words(corpus.limit(0), ["id"])
    assert count_changes(empty, vocab, spark.createDataFrame(AFTER, VOCAB), ["id"], 0).count() == 0


def test_random_vocabularies(spark):
    rng = random.Random(3)
    words = [a + b for a in "abcdefgh" for b in "vwxyz"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    index = index_words(corpus, ["id"])
    plain = Counter(w for text in texts for w in text.split())
    tables = [[(i, w, False) for i, w in enumerate(rng.sample(words, 25))] for _ in range(2)]
    frames = [spark.createDataFrame(rows, VOCAB) for rows in tables]
    found = counted(apply_changes(count_corpus(corpus, frames[0], None), count_changes(index, *frames, ["id"])))
    assert found == {i: plain[w] for i, w, _ in tables[1] if plain[w]}
