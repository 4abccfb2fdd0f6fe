"""Katz backoff language models: discounted n-gram counts, exactly normalised backoff weights, recursive scores.

Documents are gathered into blocks of bounded size, and what a block knows or asks is packed into one row per block and
bucket: its distinct n-grams, as sorted 64-bit hashes, with how often its training texts have them. A bucket, a range of
hashes, adds up the rows of all blocks, writes the model's part of the n-gram table and answers every block in the order in
which it asked. So no n-gram moves more than once per block, however frequent it is, and no group grows with a word's
frequency.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, shared_folder
from lexloom.llm.shared import fold

# A block ends with the text that brings it to so many tokens.
BLOCK_TOKENS = 3 << 20
# Longer texts are taken in parts of about so many bytes.
PART_BYTES = 4 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Buckets are so many that one gets about this number of rows' n-grams, and at least one per shuffle partition.
BUCKET_NGRAMS = 1 << 20
# Counts above this are taken as they are.
GOOD_TURING_MAX = 5
# Hashed like words, which have no blanks.
END, START = b" end", b" start"
SEED = 0
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0 or doubles, byte by byte and compressed."""
    if values.dtype.kind == "f":
        values, mark = values.view("<u8"), b"f"
    else:
        largest = int(values.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if largest < 1 << (8 * w))
        values, mark = values.astype(f"<u{width}"), str(width).encode()
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return mark + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = 8 if data[:1] == b"f" else int(data[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view("<f8" if data[:1] == b"f" else f"<u{width}").ravel()
    return values if data[:1] == b"f" else values.astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def chain(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context followed by a word."""
    mixed = (context ^ (context >> np.uint64(31))) * _FIRST + word
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SECOND
    return mixed ^ (mixed >> np.uint64(32))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(distinct values in order, a place of each, and for every value its number)`, in little memory."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int32)
    order = np.argsort(values)
    ordered = values[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    numbers = np.empty(len(values), np.int32)
    numbers[order] = np.cumsum(begins, dtype=np.int32) - 1
    return ordered[begins], order[begins], numbers


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


class _Places(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


BLOCK = "block bigint, tokens binary, words binary, lengths binary, leads binary, train binary"


def _word_lists(text: str | None, part_bytes: int) -> Iterator[list[bytes]]:
    """The tokens of a text in lists of bounded size, the end token last."""
    data = (text or "").encode().lower()
    at = 0
    while len(data) - at > part_bytes:
        cut = _BLANK.search(data, at + part_bytes)
        if not cut:
            break
        words = data[at : cut.start()].split()
        if words:
            yield words
        at = cut.start()
    yield [*data[at:].split(), END]


def make_blocks(
    docs: DataFrame, key: str, text: str, train: Column, order: int, block_tokens: int = BLOCK_TOKENS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per block: the tokens of texts, or of parts of long ones, as places in its list of word hashes.

    A part begins with the tokens before it, as far as n-grams reach back; `leads` tells how many. `docs` numbers texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["key"].dataType
    names = ["block", "tokens", "words", "lengths", "leads", "train", "keys", "docs"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = doc = TaskContext.get().partitionId() << 33
        places, ids, lengths, leads, trained, keys, numbers, held, key_type = _Places(), [], [], [], [], [], [], 0, None

        def block():
            whole = [np.array(v, np.uint64) for v in (lengths, leads, trained)]
            hashes = np.array([_hash(w) for w in places], np.uint64)
            arrays = [pa.array([x]) for x in (number, pack(np.concatenate(ids)), pack(hashes), *map(pack, whole))]
            lists = [pa.array([keys], pa.list_(key_type)), pa.array([numbers], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, *lists], names)

        for batch in batches:
            key_type = batch.schema.field("key").type
            for name, content, is_train in zip(batch.column("key"), batch.column("text"), batch.column("train")):
                lead: list[bytes] = []
                for found in _word_lists(content.as_py(), part_bytes):
                    found = lead + found
                    ids.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
                    lengths.append(len(found))
                    leads.append(len(lead))
                    trained.append(is_train.as_py())
                    keys.append(name.as_py())
                    numbers.append(doc)
                    lead = found[len(found) - order + 1 :] if len(found) >= order else found
                    held += len(found)
                    if held >= block_tokens:
                        yield block()
                        number += 1
                        places, ids, lengths, leads, trained, keys, numbers, held = _Places(), [], [], [], [], [], [], 0
                doc += 1
        if lengths:
            yield block()

    return rows.mapInArrow(gather, f"{BLOCK}, keys array<{kind.simpleString()}>, docs array<bigint>")


class Block:
    """A block's tokens as n-gram and context hashes."""

    def __init__(self, row: dict):
        self.hashes = unpack(row["words"])
        self.tokens = unpack(row["tokens"]).astype(np.int32)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.leads = unpack(row["leads"]).astype(np.int64)
        self.train = unpack(row["train"]).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Leading tokens of a part only give context to those behind them.
        self.own = np.ones(len(self.tokens), bool)
        for start, lead in zip(self.starts[self.leads > 0], self.leads[self.leads > 0]):
            self.own[start : start + lead] = False

    def contexts(self, order: int) -> np.ndarray:
        """For every token the hash of the `order - 1` words before it; texts begin behind start marks."""
        found = np.zeros(len(self.tokens), np.uint64)
        for back in range(order - 1, 0, -1):
            before = np.full(len(self.tokens), _hash(START), np.uint64)
            before[back:] = self.hashes[self.tokens[:-back]]
            for ahead in range(back):
                # Tokens fewer than `back` places behind the start of their part have nothing there.
                before[(self.starts + ahead)[self.lengths > ahead]] = _hash(START)
            found = chain(found, before)
        return found

    def ngrams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`(distinct hashes, a token of each, and its number for each token)`, in the order of hashes."""
        if order > 1:
            return _distinct(chain(self.contexts(order), self.hashes[self.tokens]))
        keys, _, numbers = _distinct(self.hashes)
        numbers = numbers[self.tokens]
        first = np.zeros(len(keys), np.int64)
        first[numbers] = np.arange(len(numbers))
        return keys, first, numbers

    def trained(self, places: np.ndarray, size: int) -> np.ndarray:
        """How often training texts have each n-gram."""
        mask = np.repeat(self.train, self.lengths) & self.own
        return np.bincount(places[mask], minlength=size).astype(np.uint64)


ASKED = "kind string, ord int, bucket int, block bigint, keys binary, counts binary, discounted binary, lower binary"


def _asked(kind: str, order: int, block: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[dict]:
    """Rows for the buckets that hold some of a block's sorted keys."""
    cuts = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1)) if buckets > 1 else []
    cuts = np.concatenate([[0], cuts, [len(keys)]]).astype(np.int64)
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[bucket], cuts[bucket + 1])
        packed = dict(zip(("counts", "discounted", "lower"), [pack(v[part]) for v in values]))
        yield {"kind": kind, "ord": order, "bucket": bucket, "block": block, "keys": pack_sorted(keys[part]), **packed}


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])


def ask_counts(blocks: DataFrame, orders: list[int], buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for order in orders:
                    keys, _, places = block.ngrams(order)
                    yield _batch(list(_asked("count", order, row["block"], buckets, keys, block.trained(places, len(keys)))), ASKED)

    return blocks.drop("keys", "docs").mapInArrow(ask, ASKED)


TOLD = "kind string, ord int, bucket int, block bigint, a binary, b binary, stats array<bigint>"


def _add_counts(rows: list[dict]) -> Iterator[dict]:
    """A bucket of n-grams: the model's rows, counts of counts, and for each block counts and which n-grams it owns."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    counts = np.concatenate([unpack(r["counts"]) for r in rows])
    distinct, _, places = _distinct(np.concatenate(keys))
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, places, counts)
    # Exactly one block that has a training n-gram owns it: the first.
    own = np.zeros(len(places), np.uint64)
    having = np.flatnonzero(counts)
    own[having[np.unique(places[having], return_index=True)[1]]] = 1
    first = {k: rows[0][k] for k in ("ord", "bucket")}
    seen = total > 0
    stats = [int(total.sum()), int(seen.sum()), *[int((total == r).sum()) for r in range(1, GOOD_TURING_MAX + 2)]]
    yield {"kind": "ngrams", **first, "a": pack_sorted(distinct[seen]), "b": pack(total[seen]), "stats": stats}
    at = 0
    for row, part in zip(rows, keys):
        span = slice(at, at + len(part))
        yield {"kind": "count", **first, "block": row["block"], "a": pack(total[places[span]]), "b": pack(own[span])}
        at += len(part)


def _add_contexts(rows: list[dict]) -> Iterator[dict]:
    """A bucket of contexts: factors for seen n-grams and weights of the lower order, for the model and for each block."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, _, places = _distinct(np.concatenate(keys))
    sums = [np.bincount(places, np.concatenate([unpack(r[c]) for r in rows]).astype(float), len(distinct)) for c in ("counts", "discounted", "lower")]
    factor, weight = backoff(*sums)
    first = {k: rows[0][k] for k in ("ord", "bucket")}
    seen = sums[0] > 0
    yield {"kind": "contexts", **first, "a": pack_sorted(distinct[seen]), "b": pack(np.concatenate([factor[seen], weight[seen]]))}
    at = 0
    for row, part in zip(rows, keys):
        span = slice(at, at + len(part))
        yield {"kind": "context", **first, "block": row["block"], "a": pack(factor[places[span]]), "b": pack(weight[places[span]])}
        at += len(part)


def backoff(count: np.ndarray, discounted: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(factor, weight)` of contexts: a seen word gets factor * discounted count, another weight * its lower probability.

    `lower` is the lower order's probability of all seen words. At least one part in count + 1 is left for others, also
    where no count is discounted, so nothing has probability 0; with the weight all probabilities add up to 1.
    """
    seen = count > 0
    one = np.where(seen, count, 1.0)
    given = np.where(seen, discounted, 0.0) / one
    scale = np.minimum(1.0, (one / (one + 1)) / np.where(given > 0, given, 1.0))
    weight = np.where(seen, (1 - scale * given) / np.where(seen, 1 - lower, 1.0), 1.0)
    return np.where(seen, scale / one, 0.0), weight


def answer(asked: DataFrame) -> DataFrame:
    """The answers of all buckets and their part of the model, in tables by kind and order, written down."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        made = _add_counts(rows) if rows[0]["kind"] == "count" else _add_contexts(rows)
        return pa.Table.from_batches([_batch(list(made), TOLD)])

    told = asked.groupBy("kind", "ord", "bucket").applyInArrow(add, TOLD)
    return materialize(told, partition_by=("kind", "ord"))


@dataclass
class Level:
    """What holds for an order: tokens and distinct n-grams in training, and discount ratios of small counts."""

    tokens: int
    distinct: int
    ratios: list[float]


def good_turing(counts_of_counts: list[int]) -> list[float]:
    """Ratios for counts 1, 2 …, from the numbers of n-grams with each count and one more.

    Where the numbers give no ratio between 0 and 1, as in tiny corpora, half a count is taken off instead.
    """
    top = len(counts_of_counts) - 1
    n = [0, *counts_of_counts]
    common = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    ratios = []
    for r in range(1, top + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        ratios.append(ratio if 0 < ratio < 1 else (r - 0.5) / r)
    return ratios


def level_of(told: DataFrame, order: int) -> Level:
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(GOOD_TURING_MAX + 3)]
    row = told.where((F.col("kind") == "ngrams") & (F.col("ord") == order)).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    return Level(row[0], row[1], good_turing(list(row[2:])))


def discount(counts: np.ndarray, ratios: list[float]) -> np.ndarray:
    table = np.array([0.0, *ratios])
    small = counts <= len(ratios)
    return np.where(small, table[np.where(small, counts, 0).astype(np.int64)], 1.0) * counts


class Answers:
    """What the buckets told a block, in the order of its distinct n-grams and contexts."""

    def __init__(self, rows: list[dict]):
        self.parts: dict[tuple[str, int], list[dict]] = {}
        for row in sorted(rows, key=lambda r: r["bucket"]):
            self.parts.setdefault((row["kind"], row["ord"]), []).append(row)

    def get(self, kind: str, order: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.parts[kind, order]
        return np.concatenate([unpack(r["a"]) for r in rows]), np.concatenate([unpack(r["b"]) for r in rows])


def word_model(level: Level, small: list[int]) -> tuple[float, float]:
    """The factor of discounted word counts, and the probability of an unknown word, which takes what known ones leave."""
    given = level.tokens - sum(r * n * (1 - level.ratios[r - 1]) for r, n in enumerate(small, 1))
    factor, weight = backoff(np.array([float(level.tokens)]), np.array([given]), np.array([0.0]))
    return float(factor[0]), float(weight[0])


def probabilities(block: Block, told: Answers, levels: list[Level], words: tuple[float, float], order: int) -> np.ndarray:
    """The probability of every token by the model of an order, evaluated from the lowest order up."""
    counts, _ = told.get("count", 1)
    _, _, places = block.ngrams(1)
    found = np.where(counts > 0, words[0] * discount(counts, levels[0].ratios), words[1])[places]
    for n in range(2, order + 1):
        counts, _ = told.get("count", n)
        _, _, places = block.ngrams(n)
        factor, weight = told.get("context", n)
        _, _, context = _distinct(block.contexts(n))
        seen = discount(counts, levels[n - 1].ratios)[places]
        found = np.where(counts[places] > 0, factor[context] * seen, weight[context] * found)
    return found


def _answered(blocks: DataFrame, told: DataFrame, use, schema: str) -> DataFrame:
    """`use(block row, answers)` for every block, which meets its answers by its number."""
    answers = told.where(F.col("kind").isin("count", "context")).select("kind", "ord", "bucket", "block", "a", "b")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = Answers(right.to_pylist())
        lists = {"keys", "docs"} & set(left.column_names)
        row = {name: left.column(name)[0].as_py() for name in left.column_names if name not in lists}
        row |= {name: left.column(name)[0].values for name in lists}
        return pa.Table.from_batches(list(use(row, answers)))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def score_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", train: Column | None = None, order: int = 2, block_tokens: int = BLOCK_TOKENS,
    bucket_ngrams: int = BUCKET_NGRAMS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """`key, held_out, n_tokens, n_known, train_tokens, base_score, score` of every whole text.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; every text has one end token.
    Rows with `train` true teach the model (by default all folds but the second); all rows are scored. `score` is the sum
    of log10 P(token | the `order - 1` tokens before it): discounted where the model has the n-gram, else the context's
    weight times the next lower order's. A word that training does not have gets what the words leave. `base_score` adds
    half to each count instead. A null text is empty; null keys and repeated rows are rows like others; without training
    rows every token has probability 1; an empty table gives no rows. Long texts go into several
    blocks in parts of about `part_bytes`, so memory is bounded (a single word is never cut). Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    train = fold(F.col(key)) != 1 if train is None else train
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    blocks = make_blocks(docs, key, text, train, order, block_tokens, part_bytes).checkpoint()
    tokens = blocks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]
    # About two bytes of packed tokens make a token; a power of two, as buckets are ranges of hashes.
    buckets = 1 << max(0, math.ceil(math.log2(max(1, partitions, tokens / 2 / bucket_ngrams))))
    told = answer(ask_counts(blocks, list(range(1, order + 1)), buckets))
    levels = [level_of(told, n) for n in range(1, order + 1)]
    stats = told.where("kind = 'ngrams' AND ord = 1").agg(*[F.coalesce(F.sum(F.col("stats")[r + 1]), F.lit(0)) for r in range(1, GOOD_TURING_MAX + 1)])
    words = word_model(levels[0], list(stats.first()))
    for n in range(2, order + 1):

        def ask(row: dict, answers: Answers, n: int = n) -> Iterator[pa.RecordBatch]:
            block = Block(row)
            lower = probabilities(block, answers, levels, words, n - 1)
            counts, own = answers.get("count", n)
            _, first, _ = block.ngrams(n)
            contexts, _, context = _distinct(block.contexts(n))
            mine = np.flatnonzero(own)
            at = context[first[mine]]
            values = [
                np.bincount(at, v, len(contexts)) for v in (counts[mine].astype(float), discount(counts[mine], levels[n - 1].ratios), lower[first[mine]])
            ]
            values[0] = values[0].astype(np.uint64)
            yield _batch(list(_asked("context", n, row["block"], buckets, contexts, *values)), ASKED)

        told = told.unionByName(answer(_answered(blocks.drop("keys", "docs"), told, ask, ASKED)))
    base = 0.5 * (levels[0].distinct + 1)

    def score(row: dict, answers: Answers) -> Iterator[pa.RecordBatch]:
        block = Block(row)
        _, _, places = block.ngrams(1)
        counts = answers.get("count", 1)[0].astype(float)[places]
        logs = np.log10(probabilities(block, answers, levels, words, order))
        plain = np.log10((counts + 0.5) / (levels[0].tokens + base))
        values = ((counts > 0).astype(np.int64), plain, logs)
        sums = [np.add.reduceat(np.where(block.own, v, 0), block.starts) for v in values]
        names = ["doc", "key", "train", "n_tokens", "n_known", "base_score", "score"]
        columns = (block.train, block.lengths - block.leads, *sums)
        yield pa.RecordBatch.from_arrays([row["docs"], row["keys"], *map(pa.array, columns)], names)

    numbers = "n_tokens bigint, n_known bigint, base_score double, score double"
    scored = _answered(blocks, told, score, f"doc bigint, key {kind}, train boolean, {numbers}")
    # The parts of a text come together; texts are told apart by their numbers, as keys may repeat.
    whole = scored.groupBy("doc").agg(
        F.first("key").alias(key),
        (~F.first("train")).alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
    )
    trained = F.lit(levels[0].tokens).cast("bigint").alias("train_tokens")
    return whole.select(key, "held_out", "n_tokens", "n_known", trained, "base_score", "score")
