"""Removing passages that other documents hold: suffix arrays by the difference-cover algorithm, dealt over the cluster.

A passage of `width` bytes is removed from a document if a document with a smaller key holds it too. Suffixes that share
so many bytes must come together to be sorted together. Each window of `width` bytes is therefore anchored at the least
hash of the k-grams it holds, which depends on its content alone: equal windows have equal anchors. Windows whose anchor
occurs in one document only cannot repeat and go no further. The others come as phrases, runs of windows with one anchor
and the bytes they cover; distinct phrases are dealt by anchor, and every bucket sorts their suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import forget_shuffles, materialize, release
from lexloom.llm.katz import pack_sorted, unpack_sorted
from lexloom.operators.lookup import attach

DEFAULT_WIDTH = 50
# Texts travel in blocks of about so many bytes and at most so many rows; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 1 << 15
# Of a block, so many positions are hashed at once.
PIECE = 1 << 19
# Anchors that one task compares, and phrases whose suffixes one task sorts, on average.
BUCKET_ANCHORS = 1 << 19
BUCKET_PHRASES = 1 << 13
# A longer run of windows with one anchor (as in a run of equal bytes) is cut.
RUN = 32
# Beyond so many distinct phrases around one anchor, its windows are grouped by content, each on its own.
HOT_PHRASES = 1 << 16
# Phrases with more than one in so many of all occurrences are looked up by broadcast; there are at most so many of them.
FREQUENT = 1_000
# Documents without a key count as later than all others.
NO_KEY = np.iinfo(np.int64).max

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xBF58476D1CE4E5B9)


# ---- suffix arrays ----


def _ranks(values: np.ndarray) -> np.ndarray:
    """Numbers 1, 2, … in the order of the values; equal values have one number."""
    top = int(values.max(initial=0)) + 1
    if top <= 1 << 24:
        present = np.zeros(top, np.int64)
        present[values] = 1
        return np.cumsum(present)[values]
    return np.unique(values, return_inverse=True)[1] + 1


def _packed(*columns: np.ndarray, spare: int = 1) -> np.ndarray:
    """One number for each tuple, in the order of the tuples, that leaves room for a factor of `spare`."""
    packed = columns[0]
    for at, column in enumerate(columns[1:]):
        high = int(column.max(initial=0)) + 1
        room = spare if at == len(columns) - 2 else 1
        if int(packed.max(initial=0) + 1) * high * room >= 1 << 62:
            packed = _ranks(packed)
        packed = packed * np.int64(high) + column
    return packed if int(packed.max(initial=0) + 1) * spare < 1 << 62 else _ranks(packed)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of positive integers in ascending order, by the difference cover {1, 2} mod 3.

    Triples at places 1 and 2 mod 3 are sorted and named; unless all names differ, the sequence of names is sorted by the
    same function. Suffixes at places 0 mod 3 follow from their first symbol and the rank behind it, and are merged: with
    places 1 by one symbol and a rank, with places 2 by two symbols and a rank.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(4, np.int64)])
    # With n = 1 mod 3 an empty triple at n ends the names of places 1, as every such sequence needs an end of its own.
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names = _ranks(_packed(s[sampled], s[sampled + 1], s[sampled + 2]))
    order = np.empty(len(sampled), np.int64)
    if names.max() < len(sampled):
        order = suffix_array(names)
        names[order] = np.arange(1, len(order) + 1)
    else:
        order[names - 1] = np.arange(len(names))
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = names
    by_rank = sampled[order]
    by_rank = by_rank[by_rank < n]
    high = np.int64(len(sampled) + 2)

    def after_one(at):
        return s[at] * high + rank[at + 1]

    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(after_one(zeros))]
    places = by_rank % 3
    ones, twos = by_rank[places == 1], by_rank[places == 2]
    before = np.searchsorted(after_one(ones), after_one(zeros))
    both = np.concatenate([twos, zeros])
    keys = _packed(s[both], s[both + 1], spare=int(high)) * high + rank[both + 2]
    before += np.searchsorted(keys[: len(twos)], keys[len(twos) :])
    merged = np.full(n, -1, np.int64)
    merged[before + np.arange(len(zeros))] = zeros
    merged[merged < 0] = by_rank
    return merged


def earliest_holders(phrases: list[bytes], keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each phrase, the least key of all phrases that hold it; and the number of windows of each phrase.

    A phrase whose windows agree has one number for all of them.

    Suffixes of all phrases are sorted together; those that start windows are kept in that order, and neighbours whose
    first `width` bytes agree hold the same window.
    """
    sizes = np.array([len(p) for p in phrases])
    text = np.frombuffer(b"".join(phrases), np.uint8)
    starts = np.cumsum(sizes) - sizes
    # A phrase ends with a symbol below all bytes, so that its suffixes do not run on into the next one unmarked.
    marked = np.zeros(len(text) + len(phrases), np.int64)
    place = np.arange(len(text)) + np.repeat(np.arange(len(phrases)), sizes)
    used = np.cumsum(np.bincount(text, minlength=256) > 0)
    marked[place] = used[text] + 1
    marked[starts + sizes + np.arange(len(phrases))] = 1
    back = np.full(len(marked), -1, np.int64)
    owner = np.repeat(np.arange(len(phrases)), sizes)
    opens = np.arange(len(text)) + width <= (starts + sizes)[owner]
    back[place[opens]] = np.flatnonzero(opens)
    order = back[suffix_array(marked)]
    order = order[order >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(text, width)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), PIECE // 4):
        end = min(len(order), at + PIECE // 4)
        seen = windows[order[at - 1 : end]]
        new[at:end] = (seen[1:] != seen[:-1]).any(axis=1)
    groups = np.flatnonzero(new)
    least = np.minimum.reduceat(keys[owner[order]], groups) if len(order) else keys[:0]
    found = np.zeros(len(text), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(groups, len(order))))
    counts = sizes - width + 1
    found = found[opens]
    begins = np.cumsum(counts) - counts
    agree = np.minimum.reduceat(found, begins) == np.maximum.reduceat(found, begins)
    told = np.ones(len(found), bool)
    told[agree.repeat(counts)] = False
    told[begins] = True
    return found[told], np.where(agree, 1, counts)


# ---- blocks and anchors ----


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed into blocks: rows, keys and sizes as 64-bit numbers, bytes compressed."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = batch.column("row").to_numpy()
        keys = batch.column("key").to_numpy()
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = int(total[at] - sizes[at])
            end = int(np.searchsorted(total, base + BLOCK_BYTES, "right"))
            end = min(max(end, at + 1), at + BLOCK_ROWS)
            data = b"".join(texts.slice(at, end - at).to_pylist())
            columns = [[int(rows[at])], *[[a[at:end].astype("<i8").tobytes()] for a in (rows, keys, sizes)], [packer.compress(data)]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], _BLOCK_NAMES)
            at = end


_BLOCK_NAMES = ["block", "rows", "keys", "sizes", "data"]


def _unpack(block, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sizes and bytes of a block."""
    keys, sizes = (np.frombuffer(block.column(name)[at].as_py(), "<i8") for name in ("keys", "sizes"))
    data = zstandard.ZstdDecompressor().decompress(block.column("data")[at].as_py(), max_output_size=max(1, int(sizes.sum())))
    return keys, sizes, np.frombuffer(data, np.uint8)


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _STIR
    x ^= x >> np.uint64(32)
    return x


def _kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at every position, by doubling."""
    wide, width = _stir(data.astype(np.uint64) + _MIX), 1
    found, done = None, 0
    n = len(data) - k + 1
    while True:
        if k & width:
            part = wide[done : done + n]
            found = part.copy() if found is None else _stir(found * _MIX + part)
            done += width
        if done == k:
            return found
        wide = _stir(wide[: len(wide) - width] * _MIX + wide[width:])
        width *= 2


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every `span` neighbours."""
    n, width = len(values) - span + 1, 1
    while width * 2 <= span:
        values = np.minimum(values[: len(values) - width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[span - width : span - width + n])


def window_runs(data: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`(at, count, anchor, text)`: runs of at most `RUN` neighbouring windows of a text with one anchor."""
    found = []
    k = max(1, 2 * width // 5)
    ends = np.cumsum(sizes)
    for lo in range(0, len(data) - width + 1, PIECE):
        hi = min(len(data) - width + 1, lo + PIECE)
        anchor = _least(_kgram_hashes(data[lo : hi + width - 1], k), width - k + 1)
        at = np.arange(lo, hi)
        text = np.searchsorted(ends, at, "right")
        inside = at + width <= ends[text]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(new)
        stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
        pieces = -(-(stop - first) // RUN)
        which = np.repeat(np.arange(len(first)), pieces)
        begin = first[which] + RUN * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        found.append((begin + lo, np.minimum(RUN, stop[which] - begin), anchor[begin], text[begin]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _shared_anchors(blocks: DataFrame, width: int, buckets: int) -> DataFrame:
    """`(block, anchors)`: the anchors of every block that two documents or two blocks hold, packed by bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, sizes, data = _unpack(batch, i)
                _, _, anchor, text = window_runs(data, sizes, width)
                order = np.argsort(anchor)
                anchor, key = anchor[order], keys[text[order]]
                first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
                if not len(first):
                    continue
                several = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
                anchor = anchor[first]
                bucket = ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                # Anchors ascend, and so do their buckets.
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts]),
                        pa.array([batch.column("block")[i].as_py()] * len(cuts), pa.int64()),
                        pa.array([pack_sorted(anchor[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    ],
                    ["bucket", "block", "anchors", "several"],
                )

    def compare(group: pa.Table) -> pa.Table:
        parts = [unpack_sorted(v.as_py()) for v in group.column("anchors")]
        sizes = np.array([len(p) for p in parts])
        anchor = np.concatenate(parts)
        bits = [np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=n) for v, n in zip(group.column("several"), sizes.tolist())]
        order = np.argsort(anchor, kind="stable")
        ordered, several = anchor[order], np.concatenate(bits).astype(bool)[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        first = np.flatnonzero(new)
        shared = (np.diff(np.append(first, len(ordered))) > 1) | np.logical_or.reduceat(several, first)
        keep = np.zeros(len(anchor), bool)
        keep[order] = np.repeat(shared, np.diff(np.append(first, len(ordered))))
        ends = np.cumsum(sizes)
        told = [pack_sorted(anchor[a:b][keep[a:b]]) if keep[a:b].any() else None for a, b in zip(ends - sizes, ends)]
        return pa.table({"block": group.column("block").combine_chunks(), "anchors": pa.array(told, pa.binary())})

    emitted = blocks.mapInArrow(emit, "bucket bigint, block bigint, anchors binary, several binary")
    return emitted.groupBy("bucket").applyInArrow(compare, "block bigint, anchors binary").where("anchors IS NOT NULL")


def _phrases(blocks: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """`(block, at, key, anchor, phrase)` for every run of windows with a shared anchor."""

    def cut(block: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("anchor", pa.int64()), ("phrase", pa.binary())])
        if not block.num_rows or not told.num_rows:
            return schema.empty_table()
        keys, sizes, data = _unpack(block)
        at, count, anchor, text = window_runs(data, sizes, width)
        asked = np.sort(np.concatenate([unpack_sorted(v.as_py()) for v in told.column("anchors")]))
        place = np.minimum(np.searchsorted(asked, anchor), len(asked) - 1)
        keep = asked[place] == anchor
        at, size, anchor, text = at[keep], count[keep] + width - 1, anchor[keep], text[keep]
        offsets = np.concatenate([[0], np.cumsum(size)])
        taken = data[np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])]
        phrase = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])
        whole = pa.array(np.full(len(at), block.column("block")[0].as_py()), pa.int64())
        return pa.table([whole, pa.array(at), pa.array(keys[text]), pa.array(anchor.view(np.int64)), phrase], schema=schema)

    cut_up = blocks.groupBy("block").cogroup(shared.groupBy("block"))
    return cut_up.applyInArrow(cut, "block bigint, at bigint, key bigint, anchor bigint, phrase binary")


def _holders(distinct: DataFrame, width: int) -> DataFrame:
    """`(anchor, code, least)`: for every distinct phrase the least key that holds each of its windows; one number if all agree."""
    counted = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"))
    hot = materialize(counted.where(F.col("m") > HOT_PHRASES).select("anchor", F.lit(True).alias("hot")))
    marked = attach(distinct.drop("times"), hot, ["anchor"], ["code"])
    buckets = distinct.count() // BUCKET_PHRASES + 1

    def sort(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        least, counts = earliest_holders(group.column("phrase").to_pylist(), keys, width)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(least))
        return pa.table({"anchor": group.column("anchor"), "code": group.column("code"), "least": lists})

    few = marked.where("hot IS NULL").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    found = few.groupBy("bucket").applyInArrow(sort, "anchor bigint, code bigint, least array<bigint>")
    place = F.explode(F.sequence(F.lit(1), F.octet_length("phrase") - (width - 1))).alias("n")
    windows = marked.where("hot").select("anchor", "code", "key", "phrase", place)
    windows = windows.select("anchor", "code", "key", "n", F.expr(f"substring(phrase, n, {width})").alias("window"))
    held = materialize(windows.groupBy("window").agg(F.min("key").alias("held")))
    each = attach(windows.drop("key"), held, ["window"], ["anchor", "code", "n"])
    whole = each.groupBy("anchor", "code").agg(F.expr("transform(array_sort(collect_list(struct(n, held))), x -> x.held)").alias("least"))
    return found.unionByName(whole)


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = DEFAULT_WIDTH
) -> DataFrame:
    """`(key, n_bytes, spans, kept)` for every row: the removed spans `(start, end)` of its UTF-8 bytes, and what is left.

    A byte is removed if a string of `width` bytes that covers it also starts in a row with a smaller key. Matches never
    cross rows, overlaps count, and all strings are judged on the input. A null text is empty. A null key is later than
    every other and given back as null; rows with equal keys do not remove each other's strings. Copies are told by 128 bits
    of hashes and their size, phrases around an anchor by the anchor and 64 bits. Repeated rows stay; an
    empty table gives no rows. Only `key` and `text` are read. A text must fit a task's memory some forty times over.
    """
    if width < 4:
        raise ValueError("passages have at least 4 bytes")
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    marks = {"size": F.octet_length("text"), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    named = named.withColumns(marks)
    # Whole copies of earlier documents are gone anyway, and would only make all of the first one's windows worth a look.
    same = named.where(F.col("size") >= width).groupBy("size", "h1", "h2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = materialize(same.where("n > 1").drop("n"))
    met = attach(named, copies, ["size", "h1", "h2"], ["key"])
    later = F.coalesce(F.col("first") < F.col("key"), F.lit(False))
    numbered = met.where(~later).select("key", "text", F.monotonically_increasing_id().alias("row"))
    fields = "block bigint, rows binary, keys binary, sizes binary, data binary"
    blocks = materialize(numbered.mapInArrow(_block_rows, fields))
    total = blocks.agg(F.count(F.lit(1)).alias("n")).first()["n"] * BLOCK_BYTES
    # An anchor comes every width / 4 bytes or so.
    buckets = 4 * total // width // BUCKET_ANCHORS + 1
    shared = materialize(_shared_anchors(blocks, width, buckets))
    forget_shuffles(spark)
    phrases = materialize(_phrases(blocks, shared, width), compression="zstd")
    release(shared)
    forget_shuffles(spark)
    code, windows = F.xxhash64("phrase").alias("code"), (F.octet_length("phrase") - (width - 1)).alias("n")
    grouped = phrases.groupBy("anchor", "phrase").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times"))
    distinct = materialize(grouped.withColumn("code", code), compression="zstd")
    forget_shuffles(spark)
    holders = materialize(_holders(distinct, width))
    forget_shuffles(spark)
    # The most frequent phrases are known; there are at most `FREQUENT` of them.
    share = distinct.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"] // FREQUENT
    often = materialize(distinct.where(F.col("times") > share).select("anchor", "code"))
    release(distinct)
    placed = phrases.select("block", "at", "key", "anchor", code, windows)
    judged = attach(placed, holders, ["anchor", "code"], ["block", "at"], frequent=often)
    # One bit for each window of the run that an earlier document holds.
    every = F.when(F.get("least", F.lit(0)) < F.col("key"), F.expr("shiftleft(1L, n) - 1")).otherwise(0)
    each = F.expr("aggregate(sequence(1, n), 0L, (bits, i) -> bits + if(element_at(least, i) < key, shiftleft(1L, i - 1), 0L))")
    bits = F.when(F.size("least") == 1, every).otherwise(each)
    hits = materialize(judged.select("block", "at", bits.alias("bits")).where("bits != 0"))
    for written in (phrases, holders, often):
        release(written)
    forget_shuffles(spark)

    def remove(block: pa.Table, hit: pa.Table) -> pa.Table:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
        if not block.num_rows:
            return schema.empty_table()
        keys, sizes, data = _unpack(block)
        found = np.zeros(len(data), np.int32)
        at, bits = (hit.column(name).to_numpy() for name in ("at", "bits"))
        for i in range(RUN):
            found[at[bits >> i & 1 == 1] + i] = 1
        # A byte is covered if one of the last `width` places starts a repeated string.
        seen = np.cumsum(found)
        gone = seen > np.concatenate([np.zeros(min(width, len(data)), np.int64), seen[:-width]])
        ends = np.cumsum(sizes)
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = edge[:1] = True
        opens = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])[: len(gone)]))
        closes = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False)[: len(gone)])) + 1
        text = np.searchsorted(ends, opens, "right")
        base = (ends - sizes)[text]
        parts = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], ["start", "end"])
        counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(counts), parts)
        left = np.concatenate([[0], np.cumsum(~gone)])[np.concatenate([[0], ends])].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        return pa.Table.from_arrays([pa.array(keys), pa.array(sizes), spans.cast(pa.list_(span)), kept], schema=schema)

    fields = "key bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    removed = blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(remove, fields)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("end")))
    gone = met.where(later).select("key", F.col("size").cast("bigint").alias("n_bytes"), whole.alias("spans"), F.lit(b"").alias("kept"))
    both = removed.unionByName(gone)
    return both.withColumn("key", F.nullif("key", F.lit(NO_KEY))).withColumnRenamed("key", key)
