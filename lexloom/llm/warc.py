"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, new_folder
from lexloom.llm.shared import SLICE_ROWS, bind
from lexloom.operators.lookup import attach

# Fixed values of the formats.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# An empty skippable frame. All its bytes are ASCII, so that Spark's text writer can put it behind every record and thereby
# write binary files, committed like any other output, to whatever store Spark can write to.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"

# Archives get about so many bytes of payload each, and the reader, which holds an archive in memory, refuses larger files.
ARCHIVE_BYTES = 32 << 20
MAX_ARCHIVE_BYTES = 512 << 20
# The dictionary is trained on a bounded sample: so many payloads, so many bytes of each.
SAMPLE_ROWS = 1_000
SAMPLE_BYTES = 8 << 10
DICTIONARY_BYTES = 64 << 10
_DATE = "1970-01-01T00:00:00Z"
# Tasks hand on what they have written or read when it has so many bytes.
_HELD_BYTES = 4 << 20
# A frame is read in steps of so many bytes.
_STEP = 8 << 10
_ID = "urn:lexloom:record:"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, as WARC headers have it; five bits of the digest make a character."""
    sha = F.sha1(payload)
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha, at, 10), 16, 2), 40, "0") for at in (1, 11, 21, 31)])

    def character(bits: Column, i: Column) -> Column:
        return F.substring(F.lit(BASE32), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))

    return bind(bits, lambda b: F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: character(b, i))))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(rows: DataFrame, total: int) -> bytes:
    """A Zstandard dictionary from about `SAMPLE_ROWS` of `total` rows `id, payload`; empty if that is too little.

    Rows are taken by a hash of id and payload, so tasks hand on no more than the sample, however many they are.
    """
    every = max(1, total // SAMPLE_ROWS)
    chosen = rows.where(F.pmod(F.xxhash64("id", "payload"), F.lit(every)) == 0)
    sample = chosen.select(F.substring("payload", 1, SAMPLE_BYTES).alias("p")).where(F.length("p") >= 64).orderBy("p").limit(2 * SAMPLE_ROWS).collect()
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["p"]) for r in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame with the dictionary, itself compressed."""
    content = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(content)) + content


def format_record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, size: int, refers_to: str | None) -> bytes:
    """A WARC/1.1 record with an HTTP response, which a revisit has without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    # Characters that end a header line or word are percent-encoded.
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "about:blank")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_ID}{record_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", uri)]
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "payload", min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write one record per row of `pages` to `.warc.zst` files below `path`.

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, the one with the smallest key is a response and
    the others are revisits that refer to it; all smaller payloads are responses. A null payload is an empty one, a
    null key is written as `null` and never referred to (a payload with null keys alone is a response each time);
    rows that repeat the smallest key are responses too. An empty table gives one empty archive. Keys must be unique
    among rows with different payloads, or references are ambiguous. Texts of any length make one record each.
    """
    content = F.coalesce(F.col(payload), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(uri).alias("uri"), content.alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("bigint"))
    # Lengths are compared too, so that equal digests of different lengths would not pass for equal payloads.
    firsts = materialize(
        rows.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    total, count = firsts.agg(F.coalesce(F.sum(F.col("n") * (F.col("size") + 512)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    repeated = materialize(firsts.where((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes) & F.col("first").isNotNull()).drop("n"))
    known = attach(rows, repeated, ["digest", "size"], ["id"])
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    known = known.select(F.col("id").cast("string").alias("id"), "uri", "payload", "digest", "size", refers.cast("string").alias("refers"))
    spread = known.repartition(max(1, math.ceil(total / archive_bytes)), F.xxhash64("id", "digest"))
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(rows, count))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = dictionary.value
        compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        made = [dictionary_frame(trained)] if trained else []
        held = 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, SLICE_ROWS) for r in batch.slice(at, SLICE_ROWS).to_pylist()):
                kind = "response" if row["refers"] is None else "revisit"
                record = format_record(kind, row["id"] or "null", row["uri"], row["digest"], row["payload"], row["size"], row["refers"])
                made.append(compressor.compress(record))
                held += len(made[-1])
                if held > _HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
                    made, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    written = spread.mapInArrow(frames, "value binary").select(F.col("value").cast("string"))
    written.write.option("lineSep", SEPARATOR).text(path)


def skip_frame(data: memoryview, at: int) -> tuple[int, memoryview] | None:
    """The magic number and content of the skippable frame at a place, or None if there is none."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic not in SKIPPABLE:
        return None
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    content = data[at + 8 : at + 8 + size]
    if at + 8 > len(data) or len(content) < size:
        raise ValueError("cut off in a skippable frame")
    return magic, content


def decode_frame(decompressor: zstandard.ZstdDecompressor, data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the frame at a place, and where it ends; read in steps, so that nothing behind it is copied."""
    if data[at : at + 4] != FRAME_MAGIC:
        raise ValueError("no frame begins here")
    frame = decompressor.decompressobj()
    parts = []
    while not frame.eof:
        if at >= len(data):
            raise ValueError("cut off in a frame")
        step = data[at : at + _STEP]
        parts.append(frame.decompress(step))
        at += len(step)
    return b"".join(parts), at - len(frame.unused_data)


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as it is, or compressed."""
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if content[:4] != DICTIONARY_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def parse_record(data: bytes) -> dict:
    """Headers and block of a frame's content; raises if the headers or lengths of the record do not hold."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC/1.x header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+\-.0-9A-Z^-z|~]+", name):
            raise ValueError(f"malformed header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    missing = [name for name in REQUIRED if name not in headers]
    if missing:
        raise ValueError(f"missing header {missing[0]}")
    if not re.fullmatch(r"\d+", headers["content-length"]):
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not fit a frame with {len(rest)} bytes behind the headers")
    record = {"headers": headers, "payload": None, "payload_bytes": None}
    block = rest[:size]
    if headers.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("HTTP headers do not end")
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if headers["warc-type"] == "revisit":
            record["payload_bytes"] = int(length[1]) if length else None
            return record
        if length and int(length[1]) != len(payload):
            raise ValueError("HTTP Content-Length does not fit the payload")
        record |= {"payload": payload, "payload_bytes": len(payload)}
    else:
        record |= {"payload": block, "payload_bytes": size}
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(record["payload"]):
        raise ValueError("the payload does not have the digest of its header")
    return record


def read_archive(data: bytes | pa.Buffer) -> Iterator[dict]:
    """Records of an archive with their offsets. A record that does not hold comes with `error`; a broken frame ends the
    archive with one, as the next frame cannot be found."""
    view = memoryview(data).cast("B")
    decompressor = zstandard.ZstdDecompressor()
    at = 0
    try:
        while at < len(view):
            skipped = skip_frame(view, at)
            if skipped:
                magic, content = skipped
                if magic == DICTIONARY_FRAME and at == 0:
                    decompressor = zstandard.ZstdDecompressor(dict_data=load_dictionary(bytes(content)))
                at += 8 + len(content)
                continue
            content, end = decode_frame(decompressor, view, at)
            try:
                yield {"offset": at, "error": None, **parse_record(content)}
            except ValueError as problem:
                yield {"offset": at, "error": str(problem)}
            at = end
    except (ValueError, zstandard.ZstdError) as problem:
        yield {"offset": at, "error": str(problem)}


RECORDS = "archive string, offset bigint, error string, headers map<string,string>, payload binary, payload_bytes bigint"


def read_archives(spark: SparkSession, path: str, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """`archive, offset, error, headers, payload, payload_bytes` of every record below `path`.

    Header names are in lower case. A revisit has no payload, but the length that its HTTP headers give. Records whose
    headers, lengths or digest do not hold have an `error` and nulls instead. A task holds one archive at a time, so
    larger files than `max_bytes` are refused. Empty files have no records.
    """
    found = spark.read.format("binaryFile").load(path)
    too_large = found.where(F.col("length") > max_bytes).select("path").take(1)
    if too_large:
        raise ValueError(f"{too_large[0]['path']} is larger than {max_bytes} bytes")

    kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64()]
    names = ["archive", "offset", "error", "headers", "payload", "payload_bytes"]

    def records(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for record in read_archive(content.as_buffer()):
                    headers = list(record["headers"].items()) if "headers" in record else None
                    rows.append((archive.as_py(), record["offset"], record["error"], headers, record.get("payload"), record.get("payload_bytes")))
                    held += 1_000 + len(record.get("payload") or b"")
                    if held > _HELD_BYTES:
                        yield records(rows)
                        rows, held = [], 0
                yield records(rows)

    return found.where("length > 0").select("path", "content").mapInArrow(read, RECORDS)


def record_key(header: Column) -> Column:
    """The key in a record id that `write_archives` has made."""
    return F.nullif(F.regexp_extract(header, f"^<{_ID}(.*)>$", 1), F.lit("null"))


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """Pages written to archives in the shared folder and read back: `key, payload_bytes, payload_digest, record_type,
    refers_to, error`, all from the records read."""
    path = new_folder(pages.sparkSession)
    rows = pages.select(F.col(key), F.col(uri), F.col(html).cast("binary").alias("payload"))
    write_archives(rows, path, key, uri)
    kind = pages.schema[key].dataType
    records = read_archives(pages.sparkSession, path)
    return records.select(
        record_key(F.col("headers")["warc-record-id"]).cast(kind).alias(key),
        "payload_bytes",
        F.regexp_extract(F.col("headers")["warc-payload-digest"], "^sha1:(.*)$", 1).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        record_key(F.col("headers")["warc-refers-to"]).cast(kind).alias("refers_to"),
        "error",
    )
