"""What happens to ids that are given up: words that come in, the ids they take, and the vocabulary afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.places import measured_places
from lexloom.operators.order import _require_order, number_rows
from lexloom.operators.tokens import count_placed_words, pretokenize
from lexloom.schemas import WORD_PATTERN


def incoming_words(
    corpus: DataFrame, vocab: DataFrame, order: Sequence[str], text: str = "text", pattern: str = WORD_PATTERN
) -> DataFrame:
    """Words of a corpus that the vocabulary does not have, `(rank, token, cnt, first_seen)`.

    Ranks count from 0, the most frequent word first, of equal counts the first to appear. Words are counted before they
    meet the vocabulary, and ranked in sorted ranges, so neither a frequent word nor many words come into one task.
    Runs jobs when called.
    """
    order = _require_order(corpus, order)
    places = measured_places(corpus, order)
    rows = corpus.select(places.row().alias("_row"), F.col(text).alias("_text"))
    counted = count_placed_words(pretokenize(rows, ["_row"], "_text", pattern=pattern), places)
    known = vocab.where(F.col("token").isNotNull()).select(F.col("token").alias("word")).distinct()
    unknown = counted.join(known, "word", "left_anti")
    ranked = number_rows(unknown, F.desc("_n"), F.asc("_place"), F.asc("word"), name="rank")
    return ranked.select(
        "rank", F.col("word").alias("token"), F.col("_n").alias("cnt"), places.struct(F.col("_place")).alias("first_seen")
    )


def pair_tokens(evicted: DataFrame, incoming: DataFrame) -> DataFrame:
    """`(token_id, replaced, token)`: given-up entries in order of their ids, each with the incoming word of its rank.

    Words beyond the number of free ids, and ids beyond the number of words, stay without a partner and are left out.
    """
    freed = number_rows(evicted.select("token_id", F.col("token").alias("replaced")), "token_id", name="rank")
    return freed.join(incoming.select("rank", "token"), "rank").select("token_id", "replaced", "token")


def adapt_vocab(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """The vocabulary with the incoming words in their places, and `status`: `injected` or `kept`."""
    new = pairs.select("token_id", F.col("token").alias("_token"))
    joined = vocab.join(new, "token_id", "left")
    status = F.when(F.col("_token").isNotNull(), "injected").otherwise("kept")
    return joined.select("token_id", F.coalesce("_token", "token").alias("token"), "is_special", status.alias("status"))
