"""What an adaptation of a vocabulary does to a corpus's token counts, without counting the corpus again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.operators.lookup import attach
from lexloom.operators.order import _require_order
from lexloom.operators.tokens import BROADCAST_BYTES, _with_ids, _word_ids, pretokenize
from lexloom.schemas import WORD_PATTERN


def index_words(corpus: DataFrame, order: Sequence[str], text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """An inverted index, written down: `(word, order…, n)`, how often each row of the corpus has a word.

    It serves any number of adaptations of vocabularies for the corpus; texts are read for it once. Rows are grouped
    by word and row, so no word is too frequent for a task. Rows that agree in `order` count as one.
    """
    order = _require_order(corpus, order)
    words = pretokenize(corpus, order, text, pattern=pattern)
    return materialize(words.groupBy("word", *order).agg(F.count(F.lit(1)).alias("n")))


def changed_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """`(word, id_before, id_after)` of words whose ids differ between two vocabularies; null where a vocabulary lacks it.

    Of entries with the same text the lowest id counts, as in tokenization.
    """
    old = _word_ids(before).withColumnRenamed("token_id", "id_before")
    new = _word_ids(after).withColumnRenamed("token_id", "id_after")
    return old.join(new, "word", "full").where(~F.col("id_before").eqNullSafe(F.col("id_after")))


def _touched(index: DataFrame, changed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Entries of the index whose word changes its id; a frequent word's rows are spread over tasks."""
    marked = materialize(changed.withColumn("changed", F.lit(True)))
    return attach(index, marked, ["word"], order, BROADCAST_BYTES).where("changed")


def count_changes(
    index: DataFrame, before: DataFrame, after: DataFrame, order: Sequence[str], unk_id: int | None = None
) -> DataFrame:
    """`(token_id, lost, gained)`: occurrences that leave and join every id when one vocabulary replaces the other.

    Only entries of changed words are counted, from the index alone. Words a vocabulary lacks count for `unk_id`, or for
    nothing if that is None. Ids that neither lose nor gain are left out. Runs jobs when called.
    """
    touched = _touched(index, changed_words(before, after), order)
    words = touched.groupBy("word", "id_before", "id_after").agg(F.sum("n").alias("n"))
    sides = F.array(
        F.struct(F.col("id_before").alias("token_id"), F.col("n").alias("lost"), F.lit(0).cast("bigint").alias("gained")),
        F.struct(F.col("id_after").alias("token_id"), F.lit(0).cast("bigint").alias("lost"), F.col("n").alias("gained")),
    )
    moved = _with_ids(words.select(F.explode(sides).alias("s")).select("s.*"), unk_id)
    return moved.groupBy("token_id").agg(F.sum("lost").alias("lost"), F.sum("gained").alias("gained"))


def apply_changes(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """`(token_id, cnt)` after an adaptation, from the counts before it; equal to a recount. Ids without occurrences go."""
    joined = counts.select("token_id", "cnt").join(changes, "token_id", "full")
    cnt = F.coalesce("cnt", F.lit(0)) - F.coalesce("lost", F.lit(0)) + F.coalesce("gained", F.lit(0))
    return joined.select("token_id", cnt.alias("cnt")).where(F.col("cnt") != 0)


def changed_rows(index: DataFrame, before: DataFrame, after: DataFrame, order: Sequence[str]) -> DataFrame:
    """`(order…, n_changed, n_known_before, n_known_after)` of rows that hold a changed word: its occurrences there, and
    how many of them each vocabulary has an entry for. Other rows keep their ids and are left out. Runs jobs when called."""
    touched = _touched(index, changed_words(before, after), order)

    def known(column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("n"))), F.lit(0))

    return touched.groupBy(*order).agg(
        F.sum("n").alias("n_changed"), known("id_before").alias("n_known_before"), known("id_after").alias("n_known_after")
    )
