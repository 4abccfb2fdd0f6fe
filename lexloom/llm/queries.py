"""One query per operator over the whole of its table, and the SQL with the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, embeddings, katz, language, mixing, negatives, prefixes, quality, secrets, sharding, simhash, suffixes, warc
from lexloom.llm.shared import table

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("error")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"), order=2)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan_mixture(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(RANK_FILE))
    ids = bpe.encode(F.col("text"), ranks, public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.digest(ids, ranks, public_tokenizers.PATTERN).alias("d")).select("doc_id", "d.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    sharded = sharding.shard_by_bytes(docs, 16, keep=["doc_id", "text_crc32"])
    return sharded.select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.repeated_spans(table(spark, sf_dir, "documents"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.turn_table(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return prefixes.trie_nodes(*prefixes.rebuilt_turns(turns))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


WORD_SQL = r"[^\x20\x09-\x0D]+"

OP1_SQL = """
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
    SELECT page_id, payload_bytes,
        list_aggregate(list_transform(range(0, 32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)),
            'string_agg', '') AS payload_digest
    FROM rows
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""

OP3_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
        AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a
), counted AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
), components AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counted ON a = vec_id
"""

OP4_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
), filled AS (
    -- Sources by how soon they are full; what is before a source is full, it and what follows share the rest.
    SELECT *,
        sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
    FROM sources
    WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT arg_min(rest, source_size::DOUBLE / weight) AS rest, arg_min(weights, source_size::DOUBLE / weight) AS weights
    FROM filled WHERE weight * rest <= 3 * source_size * weights
), targets AS (
    SELECT source, source_size,
        CASE WHEN weight * level.rest > 3 * source_size * level.weights THEN (3 * source_size)::DOUBLE
             ELSE (weight * level.rest)::DOUBLE / level.weights::DOUBLE END AS target
    FROM sources, level
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
        ('0x' || substr(md5('42:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


OP12_SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
    SELECT conv_id, count(*) AS n,
        -- CRC-32, bit by bit, of the digits.
        xor(list_reduce(
            list_transform(range(0, len(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i::INT + 1, 1))::BIGINT),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, k: xor(c >> 1, 3988292384 * (c & 1))),
            4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT s.conv_id, t.place, role, text FROM sized s JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 5 AND t.place < s.h
    UNION ALL
    SELECT s.conv_id, least(s.h, coalesce(b.n, 0)) + t.place - s.h, role, text
    FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.place >= s.h LEFT JOIN sized b ON b.conv_id = s.conv_id - s.conv_id % 5
), sequences AS (
    SELECT s.conv_id, coalesce(list(md5(concat(strlen(role), ':', role, text)) ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS turns,
        coalesce(list(strlen(text) ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS sizes
    FROM sized s LEFT JOIN rebuilt r ON r.conv_id = s.conv_id GROUP BY s.conv_id
), prefixes AS (
    SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns, sizes FROM sequences
), nodes AS (
    SELECT turns[:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        any_value(CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(turns)), '')) AS ends_sha256
    FROM prefixes GROUP BY ALL
), children AS (
    SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
    SELECT path[:up] AS path, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
    FROM (SELECT nodes.*, children.n, unnest(range(0, depth + 1)) AS up FROM nodes LEFT JOIN children USING (path)) GROUP BY ALL
)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums s USING (path) LEFT JOIN children c USING (path)
LEFT JOIN nodes p ON a.depth > 0 AND p.path = a.path[:a.depth - 1]
"""

OP13_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
        AND coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)
), scored AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score
    FROM vectors a JOIN vectors o ON a.vec_id <> o.vec_id AND len(a.v) = len(o.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank,
    other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_katz, op3_embedding_dedup, op4_mixing, op5_secrets, op6_bpe, op7_quality, op8_language, op9_sharding, op10_simhash, op11_suffixes, op12_prefixes, op13_negatives)
    return {f.__name__: f for f in found}


def all_oracles() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op12_prefixes": OP12_SQL, "op13_negatives": OP13_SQL}
