"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.shared import slices

# A rank file is refused beyond this size, as every executor gets it.
MAX_RANK_BYTES = 64 << 20
# Texts are encoded in pieces of about so many characters, cut where no match of the pattern can cross.
PIECE = 1 << 16
# White space of the pattern's regular expressions (Unicode White_Space; fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"
# Longer runs of white space are cut out, as matching them needs a stack as deep as they are long.
_LONG_RUN = re.compile(f"[{_SPACE}]{{1024,}}")
_CUT = re.compile(f"(?<=[^{_SPACE}\x1c-\x1f])(?=[{_SPACE}])")

_codecs: dict[bytes, Codec] = {}


class Codec:
    """One vocabulary: text to ids and ids to bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def of(rank_file: bytes, pattern: str) -> Codec:
        """The codec of a rank file, built once per Python worker."""
        name = hashlib.sha256(rank_file + pattern.encode()).digest()
        if name not in _codecs:
            _codecs[name] = Codec(rank_file, pattern)
        return _codecs[name]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for null and for empty text."""
        found = [self._encode(piece, run) for piece, run in pieces(text or "")]
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def _encode(self, piece: str, run: bool) -> np.ndarray:
        if run:
            return np.array(self.encoding._encode_single_piece(piece), "<u4")
        return np.asarray(self.encoding.encode_to_numpy(piece, disallowed_special=()), "<u4")

    def decode(self, ids) -> bytes:
        """The bytes of ids, whether or not they are whole characters."""
        return self.encoding.decode_bytes(np.asarray(ids).tolist())


def pieces(text: str):
    """`(piece, whether it is one run of white space)`, in order, such that matches never cross a cut.

    A match is white space alone or ends where white space begins, so a text can be cut before any white space that
    follows something else. Of a run of white space before something else, the last character may belong to the next
    match and all others are one match; that is where long runs are cut. The pattern must have this shape.
    """
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from _between(text, at, run.start())
        yield text[run.start() : end], True
        at = end
    yield from _between(text, at, len(text))


def _between(text: str, at: int, end: int):
    while at < end:
        cut = _CUT.search(text, at + PIECE, end) if end - at > PIECE else None
        to = cut.start() if cut else end
        yield text[at:to], False
        at = to


def read_ranks(spark: SparkSession, path: str) -> Broadcast:
    """A rank file of checked size, from a store (a URI) or the driver's disk (a plain path), sent to every executor."""
    if "://" in path:
        found = spark.read.format("binaryFile").load(path)
        size = found.agg(F.sum("length")).first()[0]
    else:
        size = os.path.getsize(path)
    if size > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    if "://" in path:
        return spark.sparkContext.broadcast(bytes(found.select("content").first()["content"]))
    with open(path, "rb") as ranks:
        return spark.sparkContext.broadcast(ranks.read())


def encode(text: Column, ranks: Broadcast, pattern: str) -> Column:
    """Ids of every whole text, as array<int>; no ids for null."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = Codec.of(ranks.value, pattern)
        parts = [pa.array([codec.encode(t).view("<i4") for t in some], pa.list_(pa.int32())) for some in slices(texts)]
        return pa.concat_arrays(parts or [pa.array([], pa.list_(pa.int32()))])

    return ids(text)


def decode(ids: Column, ranks: Broadcast, pattern: str) -> Column:
    """The bytes of every array of ids; empty for null. Ids outside the vocabulary fail."""

    @F.arrow_udf("binary")
    def content(lists: pa.Array) -> pa.Array:
        codec = Codec.of(ranks.value, pattern)
        return pa.array([codec.decode(x or []) for some in slices(lists) for x in some], pa.binary())

    return content(ids)


def digest(ids: Column, ranks: Broadcast, pattern: str) -> Column:
    """`n_tokens, ids_sha256, decoded_sha256` of ids and of the bytes they decode to. Over `encode`, both run in one pass."""

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(lists: pa.Array) -> pa.Array:
        codec = Codec.of(ranks.value, pattern)
        sizes, coded, decoded = [], [], []
        for x in lists:
            x = x.values.to_numpy() if x.is_valid else np.zeros(0, "<i4")
            sizes.append(len(x))
            coded.append(hashlib.sha256(x.astype("<i4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(x)).hexdigest())
        columns = [pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(ids)
