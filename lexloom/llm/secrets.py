"""Secret scans: candidates by pattern, and a random forest that removes false positives. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize
from lexloom.llm.shared import bind, fold, whole_row
from lexloom.operators.lookup import attach

# A candidate is a value behind a telling name, a run of at least eight characters of keys with a digit, or a long run of
# capitals and digits.
ASSIGNED = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|credential)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
CANDIDATE = (
    rf"{ASSIGNED}[^\s\"']{{6,}}"
    r"|(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}={0,2}|[A-Z0-9]{16,})"
)
# Places between characters of different classes.
TRANSITION = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
# What is a secret or harmless for certain; it only labels training rows where no labelled findings are given (fixed values).
KNOWN_VALUE = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,})$"
KNOWN_ASSIGNED = r"^[0-9A-Fa-f]{16,}$"
# Behind a telling name, a run of key characters so long, mixed and varied is no name of a variable, no call and no path.
RANDOM_ASSIGNED, RANDOM_DISTINCT, RANDOM_MIXES = r"^[A-Za-z0-9+/_=-]{16,}$", 10, 3
MIX = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
# Numbers of phones, cards and accounts, dates and times; words and short numbers; paths of words. Longer values are none.
NUMBERS = r"^[0-9][0-9+/_-]*$|^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{0,6}$"
WORDS = r"^[A-Za-z]+[0-9]{0,4}(?:[_-](?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*$"
PATH = r"^/?(?:[a-z]+(?:[_-][a-z]+)*[0-9]{0,2}/)+[a-z]*(?:[_-][a-z]+)*[0-9]{0,4}$"
HARMLESS_CHARS = 256
REDACTED = "[SECRET]"

# So much of the text around a candidate is looked at for neighbouring words.
CONTEXT = 80
# A piece of letters is a word of the dictionary if the corpus has it so often.
DICTIONARY_COUNT = 5
# The forest is fitted on at most so many labelled rows of each class, those with the smallest hashes.
TRAIN_ROWS = 10_000
TREES, DEPTH, SEED = 40, 8, 42
_PREVIOUS, _NEXT, _PATHS = 16, 8, 8


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: `key, k1, k2, n, start, length, value, assigned, left, right, path`, written down.

    `n` counts candidates of a text from 0; `start` counts characters of the text from 0. `k1` and `k2` are hashes of key
    and text. The text between candidates is cut to its ends, as far as neighbouring words are looked for.
    """
    marks = (F.xxhash64(key, text).alias("k1"), F.xxhash64(text, key, F.lit(1)).alias("k2"))
    where = F.lit(None).cast("string") if path is None else F.col(path).cast("string")
    rows = docs.select(F.col(key).alias("key"), *marks, where.alias("path"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    gaps = F.transform(
        F.split("text", CANDIDATE, -1),
        lambda s: F.struct(F.length(s).alias("size"), F.right(s, F.lit(CONTEXT)).alias("end"), F.left(s, F.lit(CONTEXT)).alias("begin")),
    )
    zipped = bind(
        F.struct(found.alias("c"), gaps.alias("g")),
        lambda x: F.arrays_zip(
            x["c"].alias("match"), F.slice(x["g"], F.lit(1), F.size(x["c"])).alias("before"), F.slice(x["g"], F.lit(2), F.size(x["c"])).alias("after")
        ),
    )
    each = rows.select("key", "k1", "k2", "path", "row", F.posexplode(zipped).alias("n", "x"))
    each = each.select("key", "k1", "k2", "path", "row", "n", "x.match", "x.before", "x.after")
    name = F.regexp_extract("match", f"^{ASSIGNED}", 0)
    each = each.withColumn("name", name).withColumn("value", F.expr("substring(match, length(name) + 1)"))
    # A text's candidates are no more than the text, which one task holds anyway.
    earlier = F.expr(
        "sum(before.size + length(match)) OVER (PARTITION BY row ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    start = (earlier - F.length("value")).cast("bigint")
    return materialize(
        each.select(
            "key", "k1", "k2", "n", start.alias("start"), F.length("value").alias("length"), "value",
            (F.col("name") != "").alias("assigned"), F.concat("before.end", "name").alias("left"), F.col("after.begin").alias("right"), "path",
        )
    )


def dictionary(docs: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """Words of letters that the corpus has at least `least` times, in lower case, counted in each task first."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("piece"))
    counted = words.where(F.length("piece") >= 3).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least).select("piece", F.lit(True).alias("known"))


def _coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add `covered`: the share of a value's characters in words of the dictionary."""
    pieces = F.array_distinct(F.split(F.lower("value"), r"[^\p{L}]+"))
    values = found.select("value").distinct().withColumn("piece", F.explode(pieces)).where(F.length("piece") >= 3)
    asked = values.select("piece").distinct()
    known = materialize(asked.join(words, "piece"))
    looked = attach(values, known, ["piece"], ["value"]).where("known")
    shares = looked.groupBy("value").agg((F.sum(F.length("piece")) / F.first(F.length("value"))).alias("covered"))
    covered = attach(found, materialize(shares), ["value"], ["k1", "n"])
    return covered.withColumn("covered", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0))))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.col("length")


def _one_hot(word: Column, size: int) -> list[Column]:
    place = F.when(word != "", F.pmod(F.xxhash64(word), F.lit(size)))
    return [F.when(place == i, 1.0).otherwise(0.0) for i in range(size)]


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add `features`: length, transitions, shares of character classes, distinct characters, dictionary coverage, marks of
    paths in and before the value, the finding's own path, and hashed neighbouring words."""
    rows = _coverage(found, words)
    before = F.split(F.trim(F.regexp_replace(F.lower("left"), r"[^\p{L}]+", " ")), " ")
    rows = rows.withColumn("before", before).withColumn("next", F.regexp_extract(F.lower("right"), r"^[^\p{L}]*(\p{L}+)", 1))
    last = F.coalesce(F.try_element_at("before", F.lit(-1)), F.lit(""))
    second = F.coalesce(F.try_element_at("before", F.lit(-2)), F.lit(""))
    values = [
        F.col("length"),
        F.regexp_count("value", F.lit(TRANSITION)) / F.col("length"),
        *[_share(p) for p in ("[0-9]", "[a-z]", "[A-Z]", "[^A-Za-z0-9]")],
        F.size(F.array_distinct(F.split("value", ""))) / F.col("length"),
        F.col("covered"),
        F.regexp_count("value", F.lit("[/.]")),
        F.col("left").rlike(r"[/.@]$").cast("double"),
        F.col("assigned").cast("double"),
        *_one_hot(F.coalesce("path", F.lit("")), _PATHS),
        *_one_hot(last, _PREVIOUS),
        *_one_hot(second, _PREVIOUS),
        *_one_hot(F.col("next"), _NEXT),
    ]
    features = array_to_vector(F.array(*[v.cast("double") for v in values]))
    return rows.withColumn("features", features).drop("before", "next")


def _in_words() -> Column:
    """Whether a value consists of words that the corpus has and of short numbers."""
    letters = F.regexp_count("value", F.lit("[A-Za-z]"))
    return F.when(F.col("length") <= HARMLESS_CHARS, F.col("value")).rlike(WORDS) & (F.col("covered") * F.col("length") > letters - 0.5)


def label_by_name(rows: DataFrame) -> DataFrame:
    """Labels for the forest where the format leaves it open: 1 for what mixes letters and digits behind a telling name
    and is not made of words and short numbers, 0 for what is, as `token=build2`. Other undecided values stay null."""
    mixed = F.col("assigned") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    by_name = F.when(mixed, F.when(_in_words(), 0.0).otherwise(1.0))
    return rows.withColumn("label", F.coalesce("label", by_name))


def label_by_format(rows: DataFrame) -> DataFrame:
    """Labels where nobody has given any: 1 for what is a secret for certain, 0 for what is certainly harmless, else null.

    Behind a telling name nothing is certainly harmless but words that the corpus has.
    """
    value = F.col("value")
    varied = (F.size(F.array_distinct(F.split(value, ""))) >= RANDOM_DISTINCT) & (F.regexp_count(value, F.lit(MIX)) >= RANDOM_MIXES)
    random = value.rlike(RANDOM_ASSIGNED) & varied & (F.col("covered") < 0.3)
    known = value.rlike(KNOWN_VALUE) | (F.col("assigned") & (value.rlike(KNOWN_ASSIGNED) | random))
    short = F.when(F.col("length") <= HARMLESS_CHARS, value)
    in_words = _in_words()
    plain = F.when(F.col("assigned"), in_words & ~value.rlike("[0-9]")).otherwise(short.rlike(NUMBERS) | short.rlike(PATH) | in_words)
    return rows.withColumn("label", F.when(known, 1.0).when(plain, 0.0))


def fit_forest(labelled: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> RandomForestClassificationModel | None:
    """A forest from `features, label`, fitted on at most `rows` rows of each class; None unless both classes occur.

    Which rows are taken depends on hashes of them alone. Every row of the corpus is scored, whatever was sampled here.
    """
    order = F.xxhash64("k1", "n", F.lit(seed))
    sample = None
    for label in (0.0, 1.0):
        some = labelled.where(F.col("label") == label).orderBy(order, "k2", "n").limit(rows).select("features", "label")
        sample = some if sample is None else sample.unionByName(some)
    sample = sample.cache()
    try:
        if len(sample.groupBy("label").count().take(2)) < 2:
            return None
        return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(sample)
    finally:
        sample.unpersist()


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", findings: DataFrame | None = None,
    threshold: float = 0.5, train_folds: int = 5,
) -> DataFrame:
    """Every candidate of every whole text with `score` (the forest's) and `is_secret`.

    `findings` are labelled findings `(key, start, label)`; without them, candidates of all folds but the first are
    labelled by format, which the features do not see, and behind telling names by their words; those about which neither
    says anything are not learnt from. The forest alone decides. If one class is missing, every candidate is of the
    other, and none is a secret if there is nothing labelled. Null and empty texts have no candidates; rows with null keys are scanned; repeated rows give their candidates each; an empty table gives no rows.
    """
    found = candidates(docs, key, text, path)
    rows = materialize(with_features(found, dictionary(docs, text)))
    if findings is None:
        labelled = label_by_name(label_by_format(rows.where(fold(F.col("key"), train_folds) != 0)))
    else:
        given = findings.select(F.col(key).alias("key"), "start", F.col("label").cast("double").alias("label"))
        labelled = rows.join(given, ["key", "start"])
    model = fit_forest(labelled)
    if model is None:
        only = labelled.agg(F.max("label").alias("l")).first()["l"] or 0.0
        scored = rows.withColumn("score", F.lit(float(only)))
    else:
        scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    scored = scored.withColumn("is_secret", F.col("score") >= threshold)
    kept = ("n", "start", "length", "value", "assigned", "covered", "k1", "k2", "score", "is_secret")
    return scored.select(F.col("key").alias(key), *kept)


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The documents with every confirmed secret replaced; those without one are as they were.

    `found` is what `scan` gave for them. Texts with secrets meet their verdicts by hashes of key and text and are put
    together from the parts between candidates. `chars`, a column with the number of characters, is kept right.
    """
    # Rows equal in key and text may differ in path, and so in verdicts; what is a secret in one of them is hidden in all.
    verdicts = found.groupBy("k1", "k2", "n").agg(F.max("is_secret").alias("is_secret"))
    listed = verdicts.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("n", "is_secret"))).alias("flags"), F.max("is_secret").alias("any"))
    listed = materialize(listed.where("any").select("k1", "k2", F.col("flags.is_secret").alias("flags")))
    packed = docs.select(
        F.xxhash64(key, text).alias("k1"), F.xxhash64(text, key, F.lit(1)).alias("k2"), F.col(text).alias("text"), whole_row(docs).alias("row")
    )
    # Many rows may be equal in key and text, all with a null key and no text, say.
    joined = attach(packed.withColumn("spread", F.monotonically_increasing_id()), listed, ["k1", "k2"], ["spread"])
    matches = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    hidden = F.zip_with(
        matches, "flags", lambda m, f: F.when(f, F.concat(F.regexp_extract(m, f"^{ASSIGNED}", 0), F.lit(REDACTED))).otherwise(m)
    )
    parts = F.zip_with(F.split("text", CANDIDATE, -1), hidden, lambda s, m: F.concat(s, F.coalesce(m, F.lit(""))))
    clean = F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    joined = joined.withColumn("clean", clean)
    count = F.when(F.col("flags").isNull(), F.col("row")[chars]).otherwise(F.length("clean")) if chars in docs.columns else None
    fields = [
        F.col("clean").alias(c) if c == text else count.cast(docs.schema[c].dataType).alias(c) if c == chars else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return joined.select(*fields)
