"""The prefix trie of conversations: double-array tries over dense turn ids, shard by shard, with shared nodes merged.

Conversations become sequences of turn ids. Sorted sequences are cut into shards, so only nodes on the way to the first or
the last sequence of a shard can have members elsewhere. Sequences are cut into bands too: the node at the end of a band
is the root of the tries of the next one. What lies on such a way is an open node; the partial aggregates of open nodes are
merged over all shards, and sums over their subtrees follow by doubling the distance to an ancestor. All other nodes are
finished within their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, release
from lexloom.operators.lookup import attach
from lexloom.operators.order import number_rows

# A sequence is cut after so many turns.
BAND = 256
# A task packs so many turn ids into one double array.
SHARD_TURNS = 1 << 16
# Keys that end at a node are joined in pieces of about so many before they meet for hashing.
PIECE_KEYS = 1 << 16

EMPTY = xxhash.xxh3_128_digest(b"")
TRIE_ROOT = bytes(16)

_NODE = (
    "node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, bytes bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, open boolean"
)
_NODE_SCHEMA = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [("bytes", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("open", pa.bool_())]
)


def node_digest(root: bytes, ids: bytes) -> bytes:
    """The node that turn ids lead to from the root of a band."""
    return xxhash.xxh3_128_digest(root + xxhash.xxh3_128_digest(ids))


class DoubleArray:
    """A trie of sorted, distinct sequences of codes from 1, packed into BASE and CHECK.

    State 0 is the root. A code leads from state s to BASE[s] + code if CHECK of that place is s.
    """

    def __init__(self, sequences: list[list[int]]):
        self.base = np.zeros(64, np.int64)
        self.check = np.full(64, -1, np.int64)
        self.check[0] = 0
        free = 1
        waiting = [(0, 0, len(sequences), 0)]
        while waiting:
            state, low, high, depth = waiting.pop()
            while low < high and len(sequences[low]) == depth:
                low += 1
            if low == high:
                continue
            codes, cuts = [], []
            for i in range(low, high):
                code = sequences[i][depth]
                if not codes or codes[-1] != code:
                    codes.append(code)
                    cuts.append(i)
            steps = np.array(codes) - codes[0]
            self._reserve(free + 1)
            while self.check[free] >= 0:
                free += 1
                self._reserve(free + 1)
            place = free
            while True:
                self._reserve(place + int(steps[-1]) + 1)
                if (self.check[place + steps] < 0).all():
                    break
                place += 1
            self.base[state] = place - codes[0]
            self.check[place + steps] = state
            for step, a, b in zip(steps.tolist(), cuts, [*cuts[1:], high]):
                waiting.append((place + step, a, b, depth + 1))

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.pad(self.base, (0, more))
            self.check = np.pad(self.check, (0, more), constant_values=-1)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states that codes lead to; -1 where there is none."""
        there = self.base[states] + codes
        inside = (there > 0) & (there < len(self.check))
        found = np.where(inside, there, 0)
        return np.where(inside & (self.check[found] == states), found, -1)


def shard_nodes(roots: list[bytes], bands: list[int], ids: list, sizes: list, counts: list, least: list, goes_on: list, band: int) -> pa.RecordBatch:
    """All nodes of one shard of sorted sequences, finished unless open."""
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]))
    root_code = {root: len(known) + 1 + i for i, root in enumerate(dict.fromkeys(roots))}
    codes = [[root_code[root], *(np.searchsorted(known, own) + 1).tolist()] for root, own in zip(roots, ids)]
    trie = DoubleArray(codes)
    n = len(trie.check)
    total, first, depth = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    weight, level, opened = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    digest = np.empty(n, object)
    lengths = np.array([len(c) for c in codes])
    counts, least = np.array(counts, np.int64), np.array(least, np.int64)
    bound = np.array(goes_on, bool)
    bound[[0, -1]] = True
    state = np.zeros(len(codes), np.int64)
    levels = []
    for at in range(int(lengths.max())):
        active = np.flatnonzero(lengths > at)
        state[active] = trie.step(state[active], np.array([codes[i][at] for i in active.tolist()]))
        here = state[active]
        np.add.at(total, here, counts[active])
        np.minimum.at(first, here, least[active])
        opened[here[bound[active]]] = True
        fresh, which = np.unique(here, return_index=True)
        levels.append(fresh)
        for node, i in zip(fresh.tolist(), active[which].tolist()):
            level[node], depth[node] = at, bands[i] * band + at
            if at:
                digest[node] = node_digest(roots[i], ids[i][:at].astype("<i8").tobytes())
                weight[node] = sizes[i][at - 1]
            else:
                digest[node] = roots[i]
                opened[node] = True
                if bands[i]:
                    # The node itself belongs to the band before, which counts its members.
                    total[node], first[node] = 0, np.iinfo(np.int64).max
    nodes = np.concatenate(levels)
    closed = ~opened
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for fresh in reversed(levels):
        own = fresh[closed[fresh]]
        leaves[own] += children[own] == 0
        saved[own] += (total[own] - 1) * weight[own]
        up = trie.check[own]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[own])
        np.add.at(saved, up, saved[own])
    up = [None if level[i] == 0 else digest[trie.check[i]] for i in nodes.tolist()]
    conv = pa.array(first[nodes], mask=first[nodes] == np.iinfo(np.int64).max)
    columns = [digest[nodes].tolist(), up, depth[nodes], conv, *(a[nodes] for a in (total, weight, children, leaves, saved, opened))]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA)], schema=_NODE_SCHEMA)


def _longs(column: pa.Array) -> list[np.ndarray]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    return [flat[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def turn_table(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """`(key, at, id, bytes)`: place from 0, dense id of (role, text) and bytes of the text of every turn, written down.

    Null keys are no conversation. Turns come in `order`, nulls first; turns of equal order by a digest of role and text.
    Only digests are sorted, over the whole table, so one conversation may have any share of the turns.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(by), F.concat(by, said)), 256))
    rows = turns.select(F.col(key).cast("bigint").alias("key"), F.col(order).alias("order"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("bytes"))
    rows = materialize(rows.where("key IS NOT NULL"))
    known = materialize(number_rows(rows.select("digest").distinct(), "digest", name="id"))
    placed = materialize(number_rows(rows, "key", F.asc_nulls_first("order"), "digest", name="no"))
    first = materialize(placed.groupBy("key").agg(F.min("no").alias("first")))
    named = attach(attach(placed, first, ["key"], ["no"]), known, ["digest"], ["no"])
    told = materialize(named.select("key", (F.col("no") - F.col("first")).alias("at"), "id", "bytes"))
    for written in (rows, known, placed, first):
        release(written)
    return told


def rebuilt_turns(turns: DataFrame, spread: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """`(key, at, id, bytes)` and the keys of all conversations, after every one has taken the head of another.

    Conversation c starts with the first h turns of c - c % `spread` (all if fewer, none if it is absent), h being the
    CRC-32 of c as text modulo `heads`, and goes on with its own turns after its first h.
    """
    sized = turns.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    head = F.crc32(F.col("key").cast("string")) % heads
    sized = sized.select("key", "n", (F.col("key") - F.col("key") % spread).alias("base"), head.alias("head"))
    donors = sized.select(F.col("key").alias("base"), F.col("n").alias("base_n"))
    plans = materialize(sized.join(donors, "base", "left").withColumn("lent", F.least("head", F.coalesce("base_n", F.lit(0)))).drop("base_n", "n"))
    own = attach(turns, plans, ["key"], ["at"]).where("at >= head")
    own = own.select("key", (F.col("lent") + F.col("at") - F.col("head")).alias("at"), "id", "bytes")
    # At most `heads` turns of a conversation meet the few that start like it.
    lent = turns.where(F.col("at") < heads).withColumnRenamed("key", "base")
    lent = lent.join(plans.select("key", "base", "head"), "base").where("at < head").select("key", "at", "id", "bytes")
    return own.unionByName(lent), plans.select("key")


def _pieces(turns: DataFrame, keys: DataFrame, band: int) -> DataFrame:
    """`(key, band, root, node, last, ids, sizes)`: the bands of every sequence, from which node to which they lead."""
    # A row without a turn stands for every key, so that empty sequences have a band too.
    nothing = [F.lit(None).cast("bigint").alias(name) for name in ("id", "bytes")]
    rows = turns.select("key", "at", "id", "bytes").unionByName(keys.select("key", F.lit(0).cast("bigint").alias("at"), *nothing))
    turn = F.when(F.col("id").isNotNull(), F.struct("at", "id", "bytes"))
    rows = rows.select("key", F.floor(F.col("at") / band).alias("band"), turn.alias("turn"))
    cut = rows.groupBy("key", "band").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    cut = cut.select("key", "band", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("sizes"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [xxhash.xxh3_128_digest(ids.astype("<i8").tobytes()) for ids in _longs(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "code"])

    cut = materialize(cut.mapInArrow(code, "key bigint, band bigint, ids array<bigint>, sizes array<bigint>, code binary"))
    # One digest for a whole band, so even the longest sequence makes a short list.
    chains = cut.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("band", "code"))).alias("chain"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for key, chain in zip(batch.column("key").to_pylist(), batch.column("chain").to_pylist()):
                root = TRIE_ROOT
                for i, link in enumerate(chain):
                    # Only an empty sequence has a band without turns.
                    node = root if link["code"] == EMPTY else xxhash.xxh3_128_digest(root + link["code"])
                    told.append((key, link["band"], root, node, i == len(chain) - 1))
                    root = node
            columns = list(zip(*told)) if told else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "band", "root", "node", "last"])

    links = chains.mapInArrow(follow, "key bigint, band bigint, root binary, node binary, last boolean")
    return materialize(cut.drop("code").join(links, ["key", "band"]))


def _ends(pieces: DataFrame) -> DataFrame:
    """`(node, ends_sha256)`: the hash of the keys that end at a node, ascending, comma-joined.

    Keys are sorted over the whole table and joined into runs where they lie; only runs meet for hashing, one at a time.
    """
    ended = pieces.where("last").select("node", "key").repartitionByRange("node", "key").sortWithinPartitions("node", "key")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, keys = batch.column("node").to_pylist(), batch.column("key").to_pylist()
            cuts = [0, *(i for i in range(1, len(node)) if node[i] != node[i - 1] or i % PIECE_KEYS == 0), len(node)]
            runs = [(node[a], keys[a], ",".join(map(str, keys[a:b])).encode()) for a, b in zip(cuts, cuts[1:]) if b > a]
            columns = list(zip(*runs)) if runs else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int64(), pa.binary()])], ["node", "first", "keys"])

    runs = ended.mapInArrow(join, "node binary, first bigint, keys binary")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for node, keys in zip(batch.column("node").to_pylist(), batch.column("keys")):
                if node == last:
                    state.update(b"," + keys.as_py())
                else:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256(keys.as_py())
            yield _hashed(done)
        if state:
            yield _hashed([(last, state.hexdigest())])

    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(partitions, "node").sortWithinPartitions("node", "first").select("node", "keys")
    return materialize(dealt.mapInArrow(digest, "node binary, ends_sha256 string"))


def _hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = list(zip(*done)) if done else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["node", "ends_sha256"])


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """`nodes` with `n_leaves` and `saved_tokens` summed over their subtrees.

    In round k every node knows its ancestor 2^k steps up and the sums over its descendants less than 2^k steps down, so
    the number of rounds is the logarithm of the depth.
    """
    sums = nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    while not sums.where("up IS NOT NULL").isEmpty():
        below = sums.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        below = materialize(below.withColumnRenamed("up", "node"))
        above = materialize(sums.select(F.col("node").alias("up"), F.col("up").alias("next")))
        joined = attach(attach(sums, below, ["node"], ["node"]), above, ["up"], ["node"])
        added = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "l"), ("saved_tokens", "s"))]
        sums = materialize(joined.select("node", F.col("next").alias("up"), *added))
    return attach(nodes.drop("n_leaves", "saved_tokens"), sums.drop("up"), ["node"], ["node"])


def trie_nodes(turns: DataFrame, keys: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences in `turns` (`key, at, id, bytes`) of all `keys`, from the empty one.

    `conv_id` is the smallest key that starts so, `parent_conv_id` that of the prefix one turn shorter (null at the root),
    `n_convs` counts keys, `n_children` the prefixes one turn longer, `n_leaves` those below without children, and
    `saved_tokens` sums (n_convs - 1) times the bytes of the last turn over the subtree. `ends_sha256` hashes the keys that
    end there. Without keys there are no rows. Places are 0, 1, 2 … in every sequence; no task has more of one sequence
    than a band, nor more of equal sequences than one.
    """
    pieces = _pieces(turns, keys, band)
    grouped = pieces.groupBy("node", "root").agg(
        F.first("ids").alias("ids"),
        F.first("sizes").alias("sizes"),
        F.first("band").alias("band"),
        F.count(F.lit(1)).alias("n"),
        F.min("key").alias("least"),
        F.max(~F.col("last")).alias("goes_on"),
    )
    grouped = materialize(grouped.drop("node"))
    size = grouped.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0)).alias("n")).first()["n"]
    shards = size // shard_turns + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns_held = [], 0
        for batch in batches:
            names = ("root", "band", "ids", "sizes", "n", "least", "goes_on")
            columns = [_longs(batch.column(n)) if n in ("ids", "sizes") else batch.column(n).to_pylist() for n in names]
            for row in zip(*columns):
                held.append(row)
                turns_held += len(row[2]) + 1
                if turns_held >= 2 * shard_turns:
                    yield shard_nodes(*map(list, zip(*held)), band)
                    held, turns_held = [], 0
        if held:
            yield shard_nodes(*map(list, zip(*held)), band)

    dealt = grouped.repartitionByRange(shards, "root", "ids").sortWithinPartitions("root", "ids")
    found = materialize(dealt.mapInArrow(pack, _NODE))
    merged = found.where("open").groupBy("node").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.max("bytes").alias("bytes"),
        *[F.sum(n).alias(n) for n in ("n_children", "n_leaves", "saved_tokens")],
    )
    merged = materialize(merged)
    below = materialize(merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("more")))
    merged = attach(merged, below, ["node"], ["node"]).withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    # An open node without children ends the last sequence of its shard.
    merged = merged.withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"),
        }
    )
    merged = materialize(_subtree_sums(materialize(merged.drop("more"))))
    columns = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return _named(found.where("NOT open").select(*columns), merged.select(*columns), _ends(pieces))


def _named(closed: DataFrame, opened: DataFrame, ends: DataFrame) -> DataFrame:
    """All nodes with their parents' keys and the hashes of what ends there."""
    nodes = materialize(closed.unionByName(opened))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = attach(attach(nodes, parents, ["parent"], ["node"]), ends, ["node"], ["node"])
    return named.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
