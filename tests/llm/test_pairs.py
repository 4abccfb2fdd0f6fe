"""SimHash, embeddings and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import embeddings, queries, simhash
from lexloom.llm.components import connected_components

SF_DIR = "/root/testdata/sf0.001"


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def test_components_of_paths_stars_and_islands(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5001), (7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    groups = {}
    for row in found:
        groups.setdefault(row["root"], set()).add(row["node"])
    assert sorted(map(len, groups.values())) == [2, 200, 201]
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("max_bits", [2, 3])
def test_simhash_against_all_pairs(spark, max_bits):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    texts = [None, "", " \t\n", "one", "ONE", "one two", "İ ß é word", base[0] * 40_000, "a b c " * 5_000]
    for i in range(40):
        words = (base * 12)[:]
        words[i * 5 % 200] = f"w{i}"
        texts.append(" ".join(words))
        texts.append("\n".join(words).upper())
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(20, texts[20]), (20, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "_k1": F.lit(1), "root": F.lit(2)})
    found = simhash.simhash_components(docs, shingle=3, max_bits=max_bits).collect()
    assert len(found) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % (1 << 64), r["component_id"]) for r in found)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= max_bits]
    root = union_find(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    want = sorted((k is None, k or 0, prints[i], least.get(root[i])) for i, (k, _) in enumerate(rows))
    assert got == want
    kept = simhash.drop_near_duplicates(docs, shingle=3, max_bits=max_bits)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert set(least.values()) <= {r["doc_id"] for r in kept.collect()}


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def plain_vectors(rows, threshold=0.93):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(map(abs, v))
        return v / np.linalg.norm(v)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold
    ]
    root = union_find(range(len(rows)), links)
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    return sorted((k is None, k or 0, count[i], least.get(root[i])) for i, (k, _, _) in enumerate(rows))


def as_sorted(found):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in found)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    center = rng.standard_normal(16)
    near = [(center + 0.05 * rng.standard_normal(16)).tolist() for _ in range(120)]
    rows = [(i, v, i % 2) for i, v in enumerate(near)] + [(500 + i, rng.standard_normal(16).tolist(), 0) for i in range(100)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, near[0], None)]
    rows += [(905, near[0][:8], 0), (906, near[2][:8], 0), (None, near[1], 1), (3, near[3], 1), (3, near[3], 1), (907, [1e300] * 16, 0), (908, [1e-300] * 16, 0), (909, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"row": F.lit(1), "codes": F.lit(2)})
    assert as_sorted(embeddings.near_vectors(df).collect()) == plain_vectors(rows)
    # The same with so small blocks that the large bucket is compared block by block.
    numbered = df.where(embeddings.usable(F.col("embedding")) & F.col("label").isNotNull() & (F.size("embedding") == 16)).withColumn("at", F.monotonically_increasing_id())
    whole, split = (
        {r["row"]: r["n"] for r in embeddings.linked_vectors(numbered, 0.93, "at", "label", "embedding", 3, 20, block_rows=b).groupBy("row").agg(F.sum("n_links").alias("n")).where("n > 0").collect()}
        for b in (2_048, 10)
    )
    assert whole == split and len(whole) > 100
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vector_query_finds_what_brute_force_finds(spark):
    rows = [tuple(r) for r in queries.table(spark, SF_DIR, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert as_sorted(queries.op3_embedding_dedup(spark, SF_DIR).collect()) == plain_vectors(rows)


def test_simhash_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF_DIR, "documents").collect()}
    prints = {k: plain_fingerprint(t) for k, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = union_find(docs, links)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF_DIR).collect()}
    assert found == {k: (f"{prints[k]:016x}", root[k]) for k in docs}
