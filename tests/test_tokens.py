"""Words, ids and counts; both ways to meet a vocabulary; order of ties."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.functions import places
from lexloom.operators import lookup, tokens
from lexloom.operators.vocab import label_vocab, unused_tokens, used_tokens, with_token_text

VOCAB = ["<unk>", "the", " ", "a", "cat", "dog", ".", "1", "\n", "한국어", "unused"]
ORDER = ["part", "row"]
BIG = 2**62


@pytest.fixture(scope="module")
def vocab(spark):
    rows = [(i, token, i == 0) for i, token in enumerate(VOCAB)]
    # A second id with the text of another must not multiply its words.
    rows.append((len(VOCAB), "cat", False))
    return spark.createDataFrame(rows, "token_id int, token string, is_special boolean").cache()


def make_corpus(spark, seed, rows=60):
    rng = random.Random(seed)
    words = ["the", " ", " ", " ", "a", "cat", "dog", ".", "12", "\n", "한국어", "zebra", "Éx"]
    data = [
        (rng.choice([-3, 0, 7]), rng.randrange(-BIG, BIG), "".join(rng.choice(words) for _ in range(rng.randrange(20))))
        for _ in range(rows)
    ]
    return spark.createDataFrame(data, "part int, row bigint, text string"), sorted(data)


def encode(text, max_length=None):
    # `[^\W\d_]` is Python's way to write a letter.
    words = re.findall(r"[^\W\d_]+|\d|[^\s\w]+|\s+", text)[:max_length]
    return [VOCAB.index(word) if word in VOCAB else 0 for word in words]


def expected_counts(data, max_length=None):
    counter, first = Counter(), {}
    for part, row, text in data:
        for pos, token in enumerate(encode(text, max_length)):
            counter[token] += 1
            first.setdefault(token, (part, row, pos))
    return counter, first


def as_dict(counts):
    return {r["token_id"]: (r["cnt"], tuple(r["first_seen"])) for r in counts.collect()}


@pytest.mark.parametrize("limit", [tokens.BROADCAST_BYTES, -1], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize("max_length", [None, 3])
def test_counts_and_first_occurrences(spark, vocab, monkeypatch, limit, max_length):
    monkeypatch.setattr(tokens, "BROADCAST_BYTES", limit)
    corpus, data = make_corpus(spark, 1)
    counter, first = expected_counts(data, max_length)
    want = {token: (counter[token], first[token]) for token in counter}
    plain = tokens.count_corpus(corpus, vocab, None, max_length=max_length, unk_id=0).collect()
    assert {r["token_id"]: r["cnt"] for r in plain} == counter
    counted = tokens.count_corpus(corpus, vocab, ORDER, max_length=max_length, unk_id=0)
    assert as_dict(counted) == want
    occurrences = tokens.tokenize(corpus, vocab, ORDER, max_length=max_length, unk_id=0)
    assert as_dict(tokens.count_tokens(occurrences, ORDER)) == want
    assert set(occurrences.columns) == {*ORDER, "pos", "token_id"}


@pytest.mark.parametrize("limit", [tokens.BROADCAST_BYTES, -1], ids=["broadcast", "shuffle"])
def test_words_outside_the_vocabulary_can_be_left_out(spark, vocab, monkeypatch, limit):
    monkeypatch.setattr(tokens, "BROADCAST_BYTES", limit)
    corpus, data = make_corpus(spark, 2)
    counter, _ = expected_counts(data)
    del counter[0]
    assert {k: v[0] for k, v in as_dict(tokens.count_corpus(corpus, vocab, ORDER)).items()} == counter
    assert tokens.tokenize(corpus, vocab, ORDER).count() == counter.total()


@pytest.mark.parametrize("order_type", ["string", "double"])
def test_order_columns_that_do_not_pack(spark, vocab, order_type):
    corpus, data = make_corpus(spark, 3)
    corpus = corpus.withColumn("row", F.col("row").cast(order_type))
    counter, _ = expected_counts(data)
    counted = tokens.count_corpus(corpus, vocab, ORDER, unk_id=0)
    got = as_dict(counted)
    assert {k: v[0] for k, v in got.items()} == counter
    again = as_dict(tokens.count_tokens(tokens.tokenize(corpus, vocab, ORDER, unk_id=0), ORDER))
    assert again == got
    assert all(isinstance(v[1][1], str if order_type == "string" else float) for v in got.values())


def test_extreme_order_values_survive_packing(spark, vocab):
    for part, row in [(-(2**31), -(2**63)), (2**31 - 1, 2**63 - 1), (0, -1), (-1, 0)]:
        corpus = spark.createDataFrame([(part, row, "zebra the")], "part int, row bigint, text string")
        got = as_dict(tokens.count_corpus(corpus, vocab, ORDER))
        assert got == {1: (1, (part, row, 2)), 2: (1, (part, row, 1))}


@pytest.mark.parametrize("dtype", ["tinyint", "smallint", "int", "bigint"])
def test_narrow_and_wide_order_columns(spark, vocab, dtype):
    top = 2 ** {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[dtype]
    low, high = -top, top - 1
    rows = [(high, high, "the"), (low, high, "the a"), (low, low, "cat the"), (0, -1, "dog"), (-1, 0, "dog")]
    columns = ["row"] if dtype == "bigint" else ["part", "row"]
    corpus = spark.createDataFrame(rows, f"part {dtype}, row {dtype}, text string")
    got = as_dict(tokens.count_corpus(corpus, vocab, columns))
    first = {1: (low, low, 2), 4: (low, low, 0), 3: (low, high, 2), 5: (-1, 0, 0)}
    if columns == ["row"]:
        first = {1: (low, 2), 4: (low, 0), 3: (high, 2), 5: (-1, 0)}
    assert {k: v[1] for k, v in got.items() if k != 2} == first


@pytest.mark.parametrize("spread", [0, 1, 1000, 2**30, 2**50, 2**62])
@pytest.mark.parametrize("start", [-(2**63), -7, 0, 2**61])
def test_measured_places_whatever_the_range(spark, vocab, spread, start):
    high = min(start + spread, 2**63 - 1)
    rows = [(high, 3, "the a"), (start, 9, "a the"), (start, 2, "cat"), (high, 1, "dog dog")]
    corpus = spark.createDataFrame(rows, "row bigint, part bigint, text string")
    got = {k: v[1] for k, v in as_dict(tokens.count_corpus(corpus, vocab, ["row", "part"])).items() if k != 2}
    want = {}
    for row, part, text in sorted(rows):
        for pos, token in enumerate(encode(text)):
            want.setdefault(token, (row, part, pos))
    del want[2]
    assert got == want


def test_form_of_places(spark):
    corpus = spark.createDataFrame([(0, 1, "a" * 100), (2**20, 5, None)], "row bigint, part int, text string")
    kind = lambda *args: type(places.measured_places(*args))
    assert kind(corpus, ["row", "part"]) is places.LongPlaces
    assert kind(corpus, ["row", "part", "row"]) is places.StructPlaces
    assert kind(corpus.withColumn("row", F.col("row") * 2**20), ["row", "part"]) is places.DecimalPlaces
    assert kind(corpus.withColumn("row", F.col("row") * 2**20), ["row"], 4) is places.LongPlaces
    assert kind(corpus.limit(0), ["row"]) is places.LongPlaces
    assert kind(corpus, ["text"]) is places.StructPlaces


def test_no_pass_over_texts_chooses_the_form(spark, tmp_path):
    spark.createDataFrame([(0, 1, "a"), (2**50, 5, "b")], "row bigint, part int, text string").write.parquet(str(tmp_path / "t"))
    broken = spark.read.parquet(str(tmp_path / "t")).withColumn("text", F.expr("raise_error('text was read')").cast("string"))
    assert type(places.measured_places(broken, ["row", "part"])) is places.DecimalPlaces


@pytest.mark.parametrize("dtype", ["int", "bigint", "string", "double", "decimal(20,0)"])
def test_null_order_columns_come_first_in_every_form(spark, vocab, dtype):
    from lexloom.plans.eviction import evict

    rows = [(None, 5, "cat dog"), (5, None, "dog cat"), (None, None, "the"), (3, 1, "the a")]
    wide = spark.createDataFrame(rows, "part int, row bigint, text string")
    for far in (0, 2**40):
        corpus = wide.withColumn("row", (F.col("row") + far).cast("bigint")).withColumn("part", F.col("part").cast(dtype))
        got = {k: v[1] for k, v in as_dict(tokens.count_corpus(corpus, vocab, ORDER, unk_id=0)).items()}
        assert {k: (v[0] is None, v[1] if v[1] is None else v[1] - far, v[2]) for k, v in got.items() if k in (1, 3, 4, 5)} == {
            1: (True, None, 0), 3: (False, 1, 2), 4: (True, 5, 0), 5: (True, 5, 2)
        }
        evicted = [r["token_id"] for r in evict(corpus, vocab, ORDER, ratio=0.8, unk_id=0).collect()]
        assert evicted == [r["token_id"] for r in evict(wide, vocab, ORDER, ratio=0.8, unk_id=0).collect()]


def test_a_corpus_that_changes_after_it_was_measured_fails(spark):
    schema = "row bigint, text string"
    rows = spark.createDataFrame([(1, "the cat"), (2, "the")], schema)
    places_now = places.measured_places(rows, ["row"])
    with pytest.raises(Exception, match="corpus changed"):
        spark.createDataFrame([(5, "the")], schema).select(places_now.row()).collect()


def test_words_are_counted_by_hash_before_the_only_large_shuffle(spark, vocab):
    corpus, _ = make_corpus(spark, 4)
    plan = tokens.count_corpus(corpus, vocab, ORDER, unk_id=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    generate = plan[: plan.index("Generate posexplode")]
    assert "HashAggregate" in generate[generate.rindex("Exchange hashpartitioning(word") :]


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_reports_do_not_depend_on_partitioning(spark, vocab, partitions):
    corpus, data = make_corpus(spark, 5, rows=12)
    counter, first = expected_counts(data)
    in_order = Counter()
    for _, _, text in data:
        in_order.update(encode(text))
    ranking = in_order.most_common()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        counts = tokens.count_corpus(corpus.repartition(int(partitions)), vocab, ORDER, unk_id=0)
        top = tokens.top_tokens(counts, 6).orderBy("rank").collect()
        rare = tokens.rare_tokens(counts, 6).orderBy("rank").collect()
        assert [(r["token_id"], r["cnt"]) for r in top] == ranking[:6]
        assert [(r["token_id"], r["cnt"]) for r in rare] == ranking[::-1][:6]
        assert [r["rank"] for r in rare] == list(range(1, 7))
        summary = tokens.usage_summary(counts).collect()[0]
        assert tuple(summary) == (len(counter), counter.total())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_asked_nothing_given(spark, vocab):
    corpus, _ = make_corpus(spark, 6)
    counts = tokens.count_corpus(corpus, vocab, ORDER, unk_id=0)
    assert tokens.top_tokens(counts, 0).isEmpty() and tokens.rare_tokens(counts, 0).isEmpty()
    nothing = tokens.count_corpus(corpus.limit(0), vocab, ORDER, unk_id=0)
    assert tuple(tokens.usage_summary(nothing).collect()[0]) == (0, 0)


def test_a_word_that_is_most_of_the_corpus_is_shared_out(spark, vocab, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lookup, "HOT_KEYS", 3)
    corpus = spark.createDataFrame([(1, i, "the cat the") for i in range(2000)], "part int, row bigint, text string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "64"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = tokens.tokenize(corpus, vocab, ORDER, unk_id=0)
        # The sum keeps the optimizer from dropping the lookup.
        by_task = found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("token_id"))
        sizes = [r["n"] for r in by_task.collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 10_000 and max(sizes) < 1_000


def test_null_text_has_no_words(spark, vocab):
    corpus = spark.createDataFrame([(1, 1, None), (1, 2, "")], "part int, row bigint, text string")
    assert tokens.count_corpus(corpus, vocab, ORDER, unk_id=0).isEmpty()


@pytest.mark.parametrize("limit", [10**30, "10**18", 10**6])
def test_limits_beyond_any_text(spark, vocab, limit):
    corpus, data = make_corpus(spark, 8)
    limit = F.lit(10**18) if limit == "10**18" else limit
    got = as_dict(tokens.count_corpus(corpus, vocab, ORDER, max_length=limit, unk_id=0))
    assert {k: v[0] for k, v in got.items()} == expected_counts(data)[0]


def test_order_is_required(spark, vocab):
    corpus, _ = make_corpus(spark, 7)
    for order in ([], ["absent"]):
        with pytest.raises(ValueError):
            tokens.count_corpus(corpus, vocab, order)


def test_vocabulary_lookups(spark, vocab):
    counts = spark.createDataFrame([(1, 5), (0, 2), (10, 1), (99, 1)], "token_id int, cnt bigint")
    everything = set(range(len(VOCAB) + 1))
    assert {r["token_id"] for r in unused_tokens(vocab, counts).collect()} == everything - {0, 1, 10}
    pruned = {r["token_id"] for r in unused_tokens(vocab, counts, prunable_only=True).collect()}
    assert pruned == {4, 5, 9, 11}
    assert {r["token_id"] for r in used_tokens(vocab, counts, prunable_only=True).collect()} == {1, 10}
    named = {r["token_id"]: r["token"] for r in with_token_text(counts, vocab).collect()}
    assert named == {1: "the", 0: "<unk>", 10: "unused", 99: None}
    status = {r["token_id"]: r["status"] for r in label_vocab(vocab, counts).collect()}
    assert status == {i: "evicted" if i in (0, 1, 10) else "kept" for i in everything}


@pytest.mark.parametrize(
    "model_max, position_max, want",
    [(8192, 2048, 8192), (100_000, 2048, 100_000), (100_001, 2048, 2048), (10**18, None, 10**18)],
)
def test_effective_max_length(spark, model_max, position_max, want):
    position = F.lit(position_max).cast("bigint")
    row = spark.range(1).select(tokens.effective_max_length(F.lit(model_max).cast("bigint"), position)).collect()[0]
    assert row[0] == want
    assert spark.range(1).select(tokens.effective_max_length(F.lit(5))).collect()[0][0] == 5
