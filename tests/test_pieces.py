"""Words in pieces, against a walk over plain strings."""

from pyspark.sql import functions as F

from lexloom.operators.pieces import count_pieces, segment_words
from lexloom.operators.tokens import pretokenize

UNK = 1


def plain_pieces(word, ids):
    at, found = 0, []
    while at < len(word):
        longest = max((n for n in range(1, len(word) - at + 1) if word[at : at + n] in ids), default=0)
        found.append((at, ids[word[at : at + longest]] if longest else UNK))
        at += longest or 1
    return found


def vocabulary(spark, entries):
    rows = [(0, "<|endoftext|>", True), (UNK, "<unk>", True), *[(i + 2, t, False) for i, t in enumerate(entries)]]
    return spark.createDataFrame(rows, "token_id int, token string, is_special boolean"), {t: i + 2 for i, t in reversed(list(enumerate(entries)))}


def test_pieces_of_words(spark):
    long = "ab" * 60
    vocab, ids = vocabulary(spark, ["a", "b", "ab", "abc", "bcd", "가", "가나", "cab", long, long + "c", "ab", "x" * 64, "x" * 65])
    ids.pop("", None)
    words = ["abcd", "cabbage", "가나다", "zzz", "<unk>", "ab" * 40, long + "cd", long + "d", "x" * 200, "y" + "x" * 129, "😀ab", None, "", "abcd"]
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, id int").withColumn("start", F.lit(1))
    found = {}
    for row in segment_words(frame, vocab, UNK).orderBy("word", "pos").collect():
        found.setdefault(row["word"], []).append((row["start"], row["token_id"]))
    assert found == {w: plain_pieces(w, ids) for w in words if w}
    # The window changes how entries are met, never which.
    again = segment_words(frame, vocab, UNK, window=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, segment_words(frame, vocab, UNK).collect()))
    assert segment_words(frame.limit(0), vocab, UNK).isEmpty()
    assert segment_words(frame.where("word = 'zzz'"), vocab.limit(0), UNK).count() == 3


def test_counts_in_pieces(spark):
    vocab, ids = vocabulary(spark, ["to", "ken", "token"])
    texts = ["token to tokento", "kent", None, "", "token tokento"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = dict(map(tuple, count_pieces(frame, vocab, UNK).collect()))
    plain = {}
    for word in [r["word"] for r in pretokenize(frame, []).collect()]:
        for _, token in [(0, ids[word])] if word in ids else plain_pieces(word, ids):
            plain[token] = plain.get(token, 0) + 1
    assert counts == plain
    assert count_pieces(frame.limit(0), vocab, UNK).isEmpty()
