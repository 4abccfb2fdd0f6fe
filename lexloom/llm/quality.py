"""Quality rules: a hashed n-gram log-likelihood ratio of trusted and raw text. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.llm.shared import BLANKS, bind, fold
from lexloom.operators.lookup import attach

BUCKETS = 1 << 14
SMOOTHING = 0.5
# Rules that hold without a model (fixed values).
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# Scores of labelled texts are counted in so many bins a unit to find the default threshold.
BINS = 1024
# Scores that the threshold is chosen by come from ratios fitted without a document's own fold, one of so many.
FOLDS = 5


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def neighbours(hashes: Column, apart: int = 1) -> Column:
    """A hash of every element and the one so many places after it; none if there are too few."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def in_buckets(hash: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(hash, F.lit(buckets)).cast("int")


def repeated_words(hashes: Column, pairs: Column, window: int = WINDOW) -> Column:
    """Words in windows that a text has more than once, the first included, from the words' hashes and their `neighbours`
    as bound arrays.

    Windows are compared by 64-bit hashes, each made of those of two shorter windows that cover it. Most texts have no two
    equal ones even of the size before, which a hash set tells; only others sort their windows.
    """
    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, s: total + s)

    def repeats(ordered: Column) -> Column:
        def again(i: Column) -> Column:
            here = F.get(ordered, i)["h"]
            same = lambda j: F.coalesce(F.get(ordered, j)["h"] == here, F.lit(False))
            return same(i - 1) | same(i + 1)

        found = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), again)
        return bind(F.sort_array(F.transform(found, lambda i: F.get(ordered, i)["i"])), covered)

    def counted(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(ordered, repeats)

    def unless_distinct(found: Column, use) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(use(found))

    def widened(found: Column, width: int) -> Column:
        """The result from the hashes of all windows of a smaller or the full width."""
        if width == window:
            return unless_distinct(found, counted)
        step = min(width, window - width)
        wider = lambda narrow: bind(neighbours(narrow, step), lambda windows: widened(windows, width + step))
        return unless_distinct(found, wider) if width + step == window else wider(found)

    start = widened(hashes, 1) if window == 1 else widened(pairs, 2)
    return F.when(F.size(hashes) <= window, F.lit(0).cast("bigint")).otherwise(start)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return F.coalesce(bind(filled, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))), F.lit(0)).cast("bigint")


def _log_ratios(raw: list[int], target: list[int]) -> list[float]:
    """Log ratios of two smoothed multinomials; all 0 if the target holds nothing."""
    if not sum(target):
        return [0.0] * len(raw)
    all_raw, all_target = sum(raw) + SMOOTHING * len(raw), sum(target) + SMOOTHING * len(raw)
    return [math.log((t + SMOOTHING) / all_target) - math.log((r + SMOOTHING) / all_raw) for t, r in zip(target, raw)]


def fit_ratios(
    docs: DataFrame, trusted: Column, part: Column, parts: int = FOLDS, text: str = "text", buckets: int = BUCKETS
) -> tuple[list[float], list[list[float]]]:
    """The log ratio of every bucket's probability in trusted and in all texts; then the same for each part of the
    table without the texts of that part (`part` is 0 … parts - 1).

    All texts are counted in one pass, in each task before the shuffle; buckets and parts are of fixed number, and so
    is the size of what comes to the driver. Without trusted texts all ratios are 0.

    Words are hashed as rows, as generated code does that faster than a function of arrays; and a row for each bucket with
    all parts' numbers keeps the counts few.
    """
    texts = docs.select(trusted.alias("trusted"), part.alias("part"), words_of(F.col(text)).alias("words"))
    follower = F.slice("words", F.lit(2), F.size("words"))
    words = texts.select("trusted", "part", F.explode(F.arrays_zip(F.col("words").alias("word"), follower.alias("next"))).alias("w"))
    here = F.xxhash64("w.word")
    pair = F.when(F.col("w.next").isNotNull(), F.xxhash64(here, F.xxhash64("w.next")))
    each = words.select("trusted", "part", F.explode(F.array(in_buckets(here, buckets), in_buckets(pair, buckets))).alias("bucket"))
    within = [F.col("part") == p for p in range(parts)]
    numbers = [F.count_if(own).alias(f"raw_{p}") for p, own in enumerate(within)]
    numbers += [F.count_if(own & F.col("trusted")).alias(f"target_{p}") for p, own in enumerate(within)]
    # The last word of a text has no pair.
    counts = each.where("bucket IS NOT NULL").groupBy("bucket").agg(*numbers).collect()
    raw, target = [[0] * buckets for _ in range(parts)], [[0] * buckets for _ in range(parts)]
    for row in counts:
        for p in range(parts):
            raw[p][row["bucket"]], target[p][row["bucket"]] = row[f"raw_{p}"], row[f"target_{p}"]
    all_raw, all_target = ([sum(numbers) for numbers in zip(*table)] for table in (raw, target))
    rest = [
        _log_ratios([a - o for a, o in zip(all_raw, own_raw)], [a - o for a, o in zip(all_target, own_target)])
        for own_raw, own_target in zip(raw, target)
    ]
    return _log_ratios(all_raw, all_target), rest


def _constant(values: list[float]) -> Column:
    """A literal array, which the optimizer folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def measure(
    docs: DataFrame, ratios: list[float], rest: list[list[float]], part: Column, text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """`keep` columns, `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, held_out_score` of every whole text.

    `score` is the sum of the log ratios of a text's words and word pairs divided by their number, 0 without words;
    `held_out_score` is the same by the ratios fitted without the text's own part.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    table, others = _constant(ratios), F.array(*map(_constant, rest))

    def mean(found: Column, ratios: Column) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda total, x: total + F.get(ratios, x)) / F.greatest(F.size(found), F.lit(1))

    def both(found: Column) -> Column:
        # Bound, or the part would be computed anew for every n-gram.
        without = bind(F.get(others, part), lambda ratios: mean(found, ratios))
        return F.struct(mean(found, table).alias("score"), without.alias("held_out_score"))

    def scored(hashes: Column, pairs: Column) -> Column:
        found = F.transform(F.concat(hashes, pairs), lambda h: in_buckets(h, len(ratios)))
        return F.struct(repeated_words(hashes, pairs).alias("n_repeat_words"), bind(found, both).alias("s"))

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            bind(word_hashes(words), lambda hashes: bind(neighbours(hashes), lambda pairs: scored(hashes, pairs))).alias("h"),
        )

    plain = F.regexp_replace(content, f"[{re.escape(SYMBOLS)}]", "")
    found = docs.select(
        *keep,
        (F.length(content) - F.length(plain)).cast("bigint").alias("n_symbols"),
        repeated_lines(content).alias("n_dup_lines"),
        bind(words_of(content), measured).alias("m"),
    )
    return found.select(
        *keep, "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.h.n_repeat_words", "m.h.s.score", "m.h.s.held_out_score"
    )


def best_cut(counts: list[tuple[int, int, int]]) -> float | None:
    """The score that tells classes apart with the least class-balanced error, from `(bin, good, bad)` of every filled bin.

    It is the middle of the empty bins around the cut; of equal cuts the lowest. None if a class is missing.
    """
    counts = sorted(counts)
    all_good, all_bad = sum(good for _, good, _ in counts), sum(bad for _, _, bad in counts)
    if not all_good or not all_bad:
        return None
    lost, passed = 0, all_bad
    # At first all are kept: the cut is where the lowest bin begins.
    least, cut = 1.0, float(counts[0][0])
    for (bin, good, bad), above in zip(counts, [at for at, _, _ in counts[1:]] + [counts[-1][0] + 1]):
        lost, passed = lost + good, passed - bad
        error = lost / all_good + passed / all_bad
        if error < least:
            least, cut = error, (bin + 1 + above) / 2
    return cut / BINS


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """Measures of every document with `base_failed` and `kept`.

    Texts labelled of good quality and not toxic are the trusted target, all texts the raw corpus. A document is kept
    if it passes the base rules and scores at least `threshold`, by default the held-out score that best tells trusted from
    bad ones among all labelled texts that pass the base rules (0 if one of them is missing): a text that the ratios were
    fitted on scores higher than others like it. Null and blank texts fail the base rules. A key with several labels is good if all are; null keys have no label; repeated rows are judged each; an
    empty table gives no rows.
    """
    rules = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    good = rules.agg((F.min("quality") == 1).alias("_good"), (F.max(F.coalesce("toxic", F.lit(0))) == 1).alias("_toxic"))
    labelled = materialize(good.where("_good IS NOT NULL"))
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = attach(named, labelled, ["_key"], ["_key"])
    trusted = F.coalesce(F.col("_good") & ~F.col("_toxic"), F.lit(False))
    part = fold(F.col("_key"), FOLDS)
    ratios, rest = fit_ratios(marked, trusted, part, FOLDS, "_text")
    scored = materialize(measure(named, ratios, rest, part, "_text", keep=("_key",)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    if threshold is None:
        rated = attach(scored.where(~failed).select("_key", "held_out_score"), labelled, ["_key"], ["_key", "held_out_score"])
        # Toxic texts of good quality are on neither side. Ratios are bounded, and so is the number of bins.
        bins = rated.where("NOT (_good AND _toxic)").groupBy(F.floor(F.col("held_out_score") * BINS).alias("bin"))
        counts = bins.agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).collect()
        cut = best_cut([tuple(row) for row in counts])
        threshold = 0.0 if cut is None else cut
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return judged.withColumnRenamed("_key", key)
