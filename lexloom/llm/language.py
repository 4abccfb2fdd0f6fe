"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is `known` to its best language if the language explains its n-grams, on average, better than a model to which all
buckets are equally likely. Posterior probabilities cannot tell that: summed over thousands of n-grams they come near 1 for
some language whatever the text is. N-grams of a language or script that was not learnt fall into buckets regardless of
how likely these are, so their mean log probability is below that of the even model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import bind, fold, slices, whole_row

ORDERS = (2, 3)
BUCKETS = 1 << 15
# A matrix of log probabilities has at most so many bytes; more languages than fit get further matrices.
MATRIX_BYTES = 64 << 20
GROUP = MATRIX_BYTES // 8 // (BUCKETS + 1)
SMOOTHING = 0.1
UNDETERMINED = "und"
# A task hands on its counts when it has seen so many languages.
_HELD_LANGUAGES = 64
# Characters that are worked on at once.
_BLOCK = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _normal(text: str) -> np.ndarray:
    """Code points in lower case with every run of anything but letters as one blank, and blanks at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    return points[letter | np.concatenate([[True], letter[:-1]])]


def blocks(texts: list[str], size: int = _BLOCK) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """`(indexes of texts, their code points behind each other, starts)`; a zero ends each text. Long texts come in
    several blocks that overlap by what n-grams need."""
    held: list[tuple[int, np.ndarray]] = []
    total = 0
    overlap = max(ORDERS) - 1
    for i, text in enumerate(texts):
        points = _normal(text)
        for at in range(0, len(points), size):
            # The first n-gram of every order starts in [at, at + size); later ones belong to the next block.
            part = points[at : at + size + overlap]
            held.append((i, part))
            total += len(part)
            if total >= size:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    ends = np.cumsum([len(p) + 1 for _, p in held])
    points = np.concatenate([x for _, p in held for x in (p, np.zeros(1, np.uint32))])
    return [i for i, _ in held], points, np.concatenate([[0], ends[:-1]])


def buckets(points: np.ndarray, order: int, n_buckets: int, starts: np.ndarray, size: int = _BLOCK) -> np.ndarray:
    """The bucket of the n-gram that starts at each position; `n_buckets` where it would cross a text's end."""
    code = np.zeros(len(points), np.uint64)
    whole = np.ones(len(points), bool)
    for k in range(order):
        ahead = np.concatenate([points[k:], np.zeros(k, np.uint32)])
        code = code * np.uint64(1 << 21) + ahead
        whole &= ahead != 0
    hashed = ((code ^ (code >> np.uint64(29))) * _MIX + np.uint64(order)) * _MIX
    found = (hashed >> np.uint64(64 - n_buckets.bit_length() + 1)).astype(np.int64)
    found[~whole] = n_buckets
    # Of a text's part that is followed by another, the overlap's n-grams are counted there.
    lengths = np.diff(np.append(starts, len(points)))
    for start, length in zip(starts[lengths > size + 1], lengths[lengths > size + 1]):
        found[start + size : start + length] = n_buckets
    return found


class Model:
    """Languages and the log probability of every bucket in each; the row behind the last is zero."""

    def __init__(self, languages: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.languages, self.priors, self.matrix = languages, priors, matrix

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts in every language, without priors, and their numbers of n-grams."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        n_buckets = self.matrix.shape[1] - 1
        for indexes, points, starts in blocks(texts):
            for order in ORDERS:
                found = buckets(points, order, n_buckets, starts)
                np.add.at(sizes, indexes, np.add.reduceat((found < n_buckets).astype(np.int64), starts))
                for k, row in enumerate(self.matrix):
                    np.add.at(sums[:, k], indexes, np.add.reduceat(row[found], starts))
        return sums, sizes

    def predict(self, texts: list[str | None]) -> list[dict]:
        """Per text its best language, that one's log probability `top`, the `total` of all languages' probabilities
        relative to it, and whether the text is `known`. Null and texts without a letter are `und`, of endless total."""
        named = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        sums, sizes = self.sums([texts[i] for i in named])
        even = -np.log(self.matrix.shape[1] - 1)
        found = [{"lang_pred": UNDETERMINED, "top": 0.0, "total": float("inf"), "known": False} for _ in texts]
        for i, own, size in zip(named, sums, sizes):
            scores = own + self.priors
            best = int(np.argmax(scores))
            total = float(np.exp(scores - scores[best]).sum())
            known = bool(own[best] > even * size)
            found[i] = {"lang_pred": self.languages[best], "top": float(scores[best]), "total": total, "known": known}
        return found


def _train_group(rows: DataFrame, languages: list[str], priors: np.ndarray) -> Model:
    """The matrix of some languages, from what tasks count into arrays per language."""

    def handed_on(held: dict[str, np.ndarray]):
        for name, counts in held.items():
            some = np.flatnonzero(counts)
            columns = [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for texts, names in zip(slices(batch.column("text")), slices(batch.column("lang"))):
                for name in dict.fromkeys(names):
                    if name not in held and len(held) >= _HELD_LANGUAGES:
                        yield from handed_on(held)
                    counts = held.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for _, points, starts in blocks([t for t, n in zip(texts, names) if t and n == name]):
                        for order in ORDERS:
                            found = buckets(points, order, BUCKETS, starts)
                            counts += np.bincount(found, minlength=BUCKETS + 1)[:BUCKETS]
        yield from handed_on(held)

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row of at most `BUCKETS` numbers per language reaches the driver.
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).select("lang", "c.bucket", "c.n").toArrow()
    matrix = np.zeros((len(languages), BUCKETS + 1))
    place = {name: k for k, name in enumerate(languages)}
    for name, places, counts in zip(packed["lang"].to_pylist(), packed["bucket"].combine_chunks(), packed["n"].combine_chunks()):
        matrix[place[name], places.values.to_numpy()] = counts.values.to_numpy()
    smooth = matrix[:, :-1] + SMOOTHING
    matrix[:, :-1] = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    return Model(languages, priors, matrix)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[Model]:
    """Learn from all rows with a language; null and letterless texts count as documents only.

    Every model holds up to `GROUP` languages in a matrix of at most `MATRIX_BYTES`, formed on the driver; the number of
    buckets is the same for any number of languages. Without a labelled row there is one model without a language.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    shares = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    languages = [row["lang"] for row in shares]
    documents = np.array([row["n"] for row in shares], float)
    priors = np.log(documents / max(1.0, documents.sum()))
    models = []
    for at in range(0, max(1, len(languages)), GROUP):
        names = languages[at : at + GROUP]
        some = rows if len(languages) <= GROUP else rows.where(F.col("lang").between(names[0], names[-1]))
        models.append(_train_group(some, names, priors[at : at + GROUP]))
    return models


def predict(text: Column, models: list[Broadcast]) -> Column:
    """`lang_pred, score, known` of every whole text by broadcast models, each of bounded size; of equally likely languages
    the first by name."""

    def by(model: Broadcast) -> Column:
        @F.arrow_udf("lang_pred string, top double, total double, known boolean")
        def predicted(texts: pa.Array) -> pa.Array:
            rows = [row for some in slices(texts) for row in model.value.predict(some)]
            return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("top", pa.float64()), ("total", pa.float64()), ("known", pa.bool_())]))

        # Not deterministic to the optimizer only: else a filter on the result would predict a second time.
        return predicted.asNondeterministic()(text)

    def joined(found: Column) -> Column:
        top = F.array_max(F.transform(found, lambda g, k: F.struct(g["top"].alias("top"), (-k).alias("k"))))

        def merged(top: Column) -> Column:
            total = F.aggregate(found, F.lit(0.0), lambda sum, g: sum + g["total"] * F.exp(g["top"] - top["top"]))
            best = F.element_at(found, 1 - top["k"])
            return F.struct(best["lang_pred"].alias("lang_pred"), (1 / total).alias("score"), best["known"].alias("known"))

        return bind(top, merged)

    return bind(F.array(*[by(model) for model in models]), joined)


def _broadcast(docs: DataFrame, models: list[Model]) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(model) for model in models]


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """`(key, held_out, lang_pred, score)`: learnt from all folds but the first, predicted for every row.

    Null keys are in the fold of empty text. Languages that no row outside the first fold has cannot be predicted;
    if there is none at all, every prediction is `und`. An empty table gives no rows.
    """
    held_out = fold(F.col(key), folds) == 0
    models = _broadcast(docs, train(docs.where(~held_out), text, lang))
    found = docs.select(key, held_out.alias("held_out"), predict(F.col(text), models).alias("p"))
    return found.select(key, "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.5) -> DataFrame:
    """Documents whose language can be told: those with a letter, a posterior probability of `min_score` or more, and
    n-grams that the language knows; texts in languages and scripts that were not learnt go.

    They keep all their columns; `lang` becomes the prediction.
    """
    models = _broadcast(docs, train(docs.where(fold(F.col(key)) != 0), text, lang))
    packed = docs.select(predict(F.col(text), models).alias("p"), whole_row(docs).alias("row"))
    kept = packed.where((F.col("p.score") >= min_score) & (F.col("p.lang_pred") != UNDETERMINED) & F.col("p.known"))
    return kept.select(*[F.col("p.lang_pred").alias(lang) if c == lang else F.col("row")[c].alias(c) for c in docs.columns])
