"""Words that a vocabulary lacks, as pieces that it has: longest match from the left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.operators.lookup import attach
from lexloom.operators.tokens import BROADCAST_BYTES, pretokenize
from lexloom.schemas import WORD_PATTERN

# Entries up to so many characters are looked up at every place of a word; longer ones where their first characters are.
WINDOW = 64


def piece_ids(vocab: DataFrame) -> DataFrame:
    """`(piece, token_id)`: one id, the lowest, for each text of the vocabulary that may stand inside a word."""
    usable = vocab.where("NOT is_special AND token != ''")
    return usable.groupBy(F.col("token").alias("piece")).agg(F.min("token_id").alias("token_id"))


def _walk(matches: Column, length: Column, unk_id: int) -> Column:
    """The pieces of a word, from the longest match at every place (start, n, token_id), in order of places."""

    @F.arrow_udf("array<struct<start: int, token_id: int>>")
    def walk(found: pa.Array, lengths: pa.Array) -> pa.Array:
        words = []
        for places, length in zip(found, lengths.to_pylist()):
            longest = {p["start"]: (p["n"], p["token_id"]) for p in places.as_py() or ()}
            at, pieces = 1, []
            while at <= length:
                n, token_id = longest.get(at, (1, unk_id))
                pieces.append({"start": at - 1, "token_id": token_id})
                at += n
            words.append(pieces)
        return pa.array(words, pa.list_(pa.struct([("start", pa.int32()), ("token_id", pa.int32())])))

    return walk(matches, length)


def segment_words(words: DataFrame, vocab: DataFrame, unk_id: int, word: str = "word", window: int = WINDOW) -> DataFrame:
    """`(word, pos, start, token_id)`: the pieces of every distinct word of a table, numbered from 0 as `pos`.

    At every place the longest entry of the vocabulary that the rest of the word begins with is taken; where there is
    none, one character becomes `unk_id`. Special entries never match. `start` counts characters from 0. Null and empty
    words have no pieces. Runs jobs when called.

    Distinct words alone do any work. Each of their places meets the vocabulary by the texts of up to `window`
    characters that begin there, so work grows with the length of a word, not its square, and frequent pieces are looked
    up by `attach`. An entry longer than that is compared only where its first `window` characters are found.
    """
    distinct = words.select(F.col(word).alias("word")).where("word != ''").distinct()
    # Places refer to words by number, as a long word has many.
    numbered = materialize(distinct.withColumns({"id": F.monotonically_increasing_id(), "length": F.char_length("word")}))
    ids = materialize(piece_ids(vocab))
    rest = F.transform(F.sequence(F.lit(1), "length"), lambda i: F.col("word").substr(i, F.lit(window)))
    places = numbered.select("id", F.posexplode(rest).alias("at", "rest")).select("id", (F.col("at") + 1).alias("start"), "rest")
    begun = places.select("id", "start", "rest", F.explode(F.sequence(F.lit(1), F.char_length("rest"))).alias("n"))
    begun = begun.select("id", "start", "n", F.col("rest").substr(F.lit(1), F.col("n")).alias("piece"))
    short = ids.where(F.char_length("piece") <= window)
    met = attach(begun, short, ["piece"], ["id", "start", "n"], BROADCAST_BYTES).where("token_id IS NOT NULL").drop("piece")
    long = ids.where(F.char_length("piece") > window).withColumn("rest", F.col("piece").substr(1, window))
    begins = places.where(F.char_length("rest") == window).join(long, "rest").join(numbered.select("id", "word"), "id")
    same = F.col("word").substr(F.col("start"), F.char_length("piece")) == F.col("piece")
    met = met.unionByName(begins.where(same).select("id", "start", F.char_length("piece").alias("n"), "token_id"))
    longest = met.groupBy("id", "start").agg(F.max(F.struct("n", "token_id")).alias("m"))
    matches = longest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "m.n", "m.token_id"))).alias("matches"))
    walked = numbered.join(matches, "id", "left").select("word", F.posexplode(_walk(F.col("matches"), F.col("length"), unk_id)).alias("pos", "piece"))
    return walked.select("word", "pos", "piece.start", "piece.token_id")


def count_pieces(
    df: DataFrame, vocab: DataFrame, unk_id: int, text: str = "text", pattern: str = WORD_PATTERN, window: int = WINDOW
) -> DataFrame:
    """`(token_id, cnt)` of a corpus whose unknown words are taken in pieces. Runs jobs when called.

    Words are counted before anything else; known ones keep their id, distinct unknown ones are segmented once.
    """
    counted = materialize(pretokenize(df, [], text, pattern=pattern).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    whole = vocab.where(F.col("token").isNotNull()).groupBy(F.col("token").alias("word")).agg(F.min("token_id").alias("token_id"))
    looked = materialize(counted.join(whole, "word", "left"))
    unknown = looked.where("token_id IS NULL").select("word", "n")
    pieces = segment_words(unknown, vocab, unk_id, window=window).groupBy("word", "token_id").agg(F.count(F.lit(1)).alias("times"))
    parts = unknown.join(pieces, "word").select("token_id", (F.col("n") * F.col("times")).alias("n"))
    every = looked.where("token_id IS NOT NULL").select("token_id", "n").unionByName(parts)
    return every.groupBy("token_id").agg(F.sum("n").alias("cnt"))
