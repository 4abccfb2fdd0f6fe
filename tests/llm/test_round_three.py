"""Suffix arrays, prefix tries and hard negatives against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from lexloom.llm import mixing, negatives, prefixes, queries, secrets, sharding, simhash, suffixes

SF_DIR = "/root/testdata/sf0.001"
NO_KEY = (1 << 63) - 1


@pytest.mark.parametrize("letters", [1, 2, 200])
def test_suffix_array_sorts_all_suffixes(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(30), 500]:
        symbols = rng.integers(1, letters + 1, n)
        assert suffixes.suffix_array(symbols).tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())


def plain_removal(rows, width):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            window = data[i : i + width]
            first[window] = min(first.get(window, NO_KEY), NO_KEY if key is None else key)
    found = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if first[data[i : i + width]] < (NO_KEY if key is None else key):
                gone[i : i + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        found.append((-1 if key is None else key, len(data), tuple(zip(edges[::2], edges[1::2])), kept))
    return sorted(found)


def removal(frame, width):
    rows = suffixes.repeated_spans(frame, width=width).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in rows)


@pytest.mark.parametrize("hot", [0, suffixes.HOT_PHRASES])
def test_repeats_against_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_PHRASES", hot)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 64)
    monkeypatch.setattr(suffixes, "BUCKET_PHRASES", 16)
    rng = np.random.default_rng(3)
    shared = ["".join(rng.choice(list("abcdé "), 60)) for _ in range(4)]
    own = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    rows = [(i, own(40) + shared[i % 4][: 20 + i] + own(30) + shared[(i + 1) % 4]) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[3][1]), (None, shared[0]), (1, shared[0])]
    rows += [(50, None), (51, ""), (52, "short"), (-5, shared[2]), (60, "a" * 400), (61, "a" * 399 + "b"), (62, own(3000))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(1) for n in ("key", "size", "row", "a.b")})
    for width in (8, 20):
        assert removal(frame, width) == plain_removal(rows, width)
    assert suffixes.repeated_spans(frame.limit(0)).isEmpty()


def test_suffix_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = [
        (k, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in plain_removal(rows, 50)
    ]
    assert sorted(map(tuple, queries.op11_suffixes(spark, SF_DIR).collect())) == want


@pytest.mark.parametrize("name", ["op12_prefixes", "op13_negatives"])
def test_queries_equal_their_sql(spark, name):
    frame = queries.all_queries()[name](spark, SF_DIR).toPandas()
    assert difference(frame, connect(SF_DIR).execute(queries.all_oracles()[name]).df()) is None


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in sorted(
        ((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, _digest(r[2], r[3]))
    ):
        turns.setdefault(conv, []).append((role, text))
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    found = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        children = sum(len(p) == len(path) + 1 for p in below)
        parent = min(members[path[:-1]]) if path else None
        found.append((min(convs), len(path), parent, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def _digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


@pytest.mark.parametrize(("band", "shard"), [(2, 1), (3, 7), (256, 1 << 16)])
def test_trie_against_all_prefixes(spark, band, shard):
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 40), 100, 101, 203, 207]:
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["hi", "é", "x", "yy"])) if t else "hello"))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 360) for t in range(9)]
    rows += [(7, None, None, None), (7, None, "", "later"), (None, 0, "user", "x"), (8, 3, "user", "tie"), (8, 3, "user", "tie"), (8, 3, "a", "tie")]
    rows += [(501, 0, "user", "alone"), (600, 0, "user", "long")] + [(600, t, "user", f"t{t % 3}") for t in range(1, 30)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({n: F.lit(1) for n in ("key", "at", "id", "node")})
    turns = prefixes.turn_table(frame.repartition(5), "conv_id", "turn", "role", "text")
    found = prefixes.trie_nodes(*prefixes.rebuilt_turns(turns), band=band, shard_turns=shard)
    assert sorted(map(tuple, found.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefixes.trie_nodes(*prefixes.rebuilt_turns(prefixes.turn_table(frame, "conv_id", "turn", "role", "text"))).isEmpty()


def test_double_array_leads_along_its_sequences_only():
    sequences = [[1], [1, 2], [1, 2, 900], [1, 3], [2, 2, 2], [5, 1], [5, 700], [5, 701]]
    trie = prefixes.DoubleArray(sequences)
    known = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    for s in known:
        state = np.array([0])
        for code in s:
            state = trie.step(state, np.array([code]))
        assert state[0] >= 0
        for code in (1, 2, 3, 5, 6, 700, 701, 900):
            assert (trie.step(state, np.array([code]))[0] >= 0) == ((*s, code) in known)


def plain_negatives(rows):
    whole = [(k, l, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for k, l, v in rows
             if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (anchor, label, v) in enumerate(whole):
        if anchor is None or anchor % 100:
            continue
        near = [(sum(map(int.__mul__, v, w)), k, l == label) for j, (k, l, w) in enumerate(whole) if j != i and len(w) == len(v)]
        for score, positive, _ in sorted([r for r in near if r[2]], key=order)[:5]:
            hard = sorted([r for r in near if not r[2] and 30 * score <= 100 * r[0] <= 90 * score], key=order)[:10]
            found += [(anchor, positive, n + 1, k, score, s) for n, (s, k, _) in enumerate(hard)]
    return sorted(found, key=str)


def test_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 16)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 3)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 10)).astype(np.float32)
    rows = [(i, int(i % 3), [float(x) for x in base[i % 6] * 0.4 + rng.standard_normal(10).astype(np.float32) * 0.2]) for i in range(700)]
    rows = [(k, l, [float(np.float32(x)) for x in v]) for k, l, v in rows]
    rows += [(200, 1, rows[200][2]), (200, 2, rows[5][2]), (None, 1, rows[200][2]), (None, 2, rows[9][2]), (300, None, rows[0][2]), (400, 1, None)]
    rows += [(500, 1, [None] * 10), (600, 1, [float("nan")] * 10), (700, 1, [1.0, 2.0]), (701, 1, [1.0, 1.0]), (702, 2, [0.5, 0.5]), (800, 1, []), (801, 1, []), (802, 2, [])]
    rows += [(900, 1, [0.0] * 10), (1000, 0, [100_000.0] * 10), (1001, 0, [100_000.0] * 10), (1002, 1, [50_000.0] * 10)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumns({n: F.lit(0) for n in ("row", "key", "slot")})
    found = negatives.hard_negatives(frame.repartition(4), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == plain_negatives(rows)
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0).isEmpty()


def test_intervals_hold_every_score():
    rng = np.random.default_rng(1)
    for size in (1, 5, 64, 100):
        rows, asked = (rng.integers(-300, 300, (40, size)) for _ in range(2))
        low, high = negatives.Queries(asked, 42).intervals(negatives.Codes(rows, 42), slice(0, 40), slice(0, 40))
        scores = rows @ asked.T
        assert (low <= scores).all() and (scores <= high).all()


def test_a_secret_in_one_of_two_equal_rows_is_hidden_in_both(spark):
    text = "token=abcdefgh12 and token=zyxwvuts98 end"
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, "plain", "a")], "doc_id bigint, text string, source string")
    found = secrets.candidates(docs).withColumn("is_secret", (F.col("n") == 1) | (F.col("path") == "a"))
    texts = [r["text"] for r in secrets.redact(docs, found).collect()]
    assert sorted(texts) == ["plain", *["token=[SECRET] and token=[SECRET] end"] * 2]


def test_slots_do_not_depend_on_partitioning(spark):
    rows = [(i, "same" if i % 3 else f"text {i}", i % 7) for i in range(3000)] + [(5, "same", 1), (5, "same", 0), (None, "same", 2), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    found = []
    for parts in (1, 9):
        sharded = sharding.shard_by_bytes(docs.repartition(parts, "extra"), 16)
        found.append(sorted((str(r["doc_id"]), str(r["text"]), r["extra"], r["_shard"], r["_slot"]) for r in sharded.collect()))
    assert found[0] == found[1]
    sizes, places = {}, {}
    for doc, text, _, shard, slot in found[0]:
        sizes[shard] = sizes.get(shard, 0) + len("" if text == "None" else text) + 1
        places.setdefault(shard, []).append(slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * sharding.GROUP_TOLERANCE * sum(sizes.values()) / 16 + 2 * len("text 2999 ")


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "one two three four", "s", 1), (2, "five six", "s", 2), (2, "five six", "s", 2)], "doc_id bigint, text string, source string, x int")
    docs = docs.withColumnRenamed("x", "a.b")
    assert mixing.mix(docs).columns == docs.columns
    assert simhash.drop_near_duplicates(docs).count() == 2
    assert sharding.shard_by_bytes(docs, 2).count() == 3
    assert secrets.redact(docs, secrets.candidates(docs).withColumn("is_secret", F.lit(True))).columns == docs.columns
