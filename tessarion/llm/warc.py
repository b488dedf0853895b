"""WARC archives with one Zstandard frame a record and a dictionary in the leading skippable frame.

An archive begins with a skippable frame that holds the dictionary (compressed by itself); each record is
a frame of its own, compressed with it, so records can be read one by one.  Records whose payload equals
that of another record are written as revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .words import slices

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 32 << 20  # of payload, after which a task begins another archive
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLES, SAMPLE_BYTES = 256, 1 << 20
LEAST_REVISIT = 1000


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record: the whole payload of a response, of a revisit the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda n: f"<urn:x-page:{'' if n is None else n}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', '') + '%')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; where they are too few, the samples' own bytes."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1"


def load_dictionary(raw: bytes) -> zstd.ZstdCompressionDict:
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY_MAGIC else zstd.DICT_TYPE_RAWCONTENT
    return zstd.ZstdCompressionDict(raw, dict_type=kind)


class ArchiveWriter:
    """One archive in a stream: the first records are held back until they have made the dictionary."""

    def __init__(self, stream):
        self.stream, self.held, self.held_bytes, self.compressor = stream, [], 0, None
        self.records = 0

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self.stream.write(self.compressor.compress(rec))
            return
        self.held.append(rec)
        self.held_bytes += len(rec)
        if len(self.held) >= DICTIONARY_SAMPLES or self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        raw = dictionary_of([r[:65536] for r in self.held])
        packed = zstd.ZstdCompressor(level=9).compress(raw)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=load_dictionary(raw), write_content_size=True, write_checksum=True)
        for rec in self.held:
            self.stream.write(self.compressor.compress(rec))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.stream.close()


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; headers are by lower-case name.

    Raises BadArchive for anything but whole, well-formed records.
    """
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8:at])
        if len(raw) != at - 8:
            raise BadArchive("the dictionary is cut off")
        if raw[:4] == FRAME_MAGIC:
            raw = zstd.ZstdDecompressor().decompress(raw)
        dictionary = load_dictionary(raw)
    context = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    while at < len(data):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise BadArchive(f"no frame at byte {at}")
        frame = context.decompressobj()
        parts, fed = [], at
        try:
            while not frame.eof:
                if fed >= len(data):
                    raise BadArchive("the last record is cut off")
                chunk = view[fed : fed + (1 << 16)]
                parts.append(frame.decompress(chunk))
                fed += len(chunk)
        except zstd.ZstdError as e:
            raise BadArchive(f"frame at byte {at}: {e}") from e
        at = fed - len(frame.unused_data)
        yield parse_record(b"".join(parts))


def parse_record(rec: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadArchive("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"not a header: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise BadArchive(f"no {need}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length does not fit")
    return headers, rest[:-4]


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload size, SHA-1, payload or None) of a page's record, checked."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    if not gap or not http.startswith(b"HTTP/") or size is None:
        raise BadArchive("no HTTP headers")
    number = lambda uri: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", uri)) else None
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise BadArchive("the payload does not fit its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise BadArchive("a revisit with a payload or without its original")
    return (number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, number(headers.get("warc-refers-to", "")), int(size[1]), digest, payload if kind == "response" else None)


def write_archives(spark: SparkSession, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) into the shared folder; their names and numbers of records.

    An archive bears the name of its task attempt, and only what successful attempts return counts, so
    a task that runs twice leaves a file that nobody reads.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    same = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    same = scratch.table(same.select("digest", "size", "original"), "same")
    rows = rows.join(same, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("original").isNotNull() & ((F.col("page_id") != F.col("original")) | F.col("page_id").isNull()), F.lit(False))
    rows = rows.select("page_id", "url", "html", "digest", F.col("size").cast("bigint").alias("size"), "original", revisit.alias("revisit"))
    folder = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        writer, written, names, counts = None, 0, [], []
        for b in slices(batches, "html", 1 << 22):
            columns = [b.column(c) for c in ("page_id", "url", "html", "size", "digest", "original", "revisit")]
            for page_id, url, html, size, digest, original, again in zip(*(c.to_pylist() for c in columns), strict=True):
                if writer is None:
                    names.append(f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.zst")
                    writer, written = ArchiveWriter(filesystem.open_output_stream(f"{root}/{names[-1]}", compression=None)), 0
                writer.add(record(page_id, url, html.encode(), size, digest, original, again))
                written += 0 if again else size
                if written >= ARCHIVE_BYTES:
                    writer.close()
                    counts.append(writer.records)
                    writer = None
        if writer is not None:
            writer.close()
            counts.append(writer.records)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["name", "records"])

    manifest = scratch.table(rows.mapInArrow(write, "name string, records bigint"), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of all records of the manifest's archives."""
    first = manifest.select("folder").first()
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    if first is None:
        return spark.createDataFrame([], schema)
    # an archive is a row here: its size is bounded when it is written
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(first["folder"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    files = files.join(manifest.select("name", "records"), "name")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data, n in zip(*(b.column(c) for c in ("name", "content", "records")), strict=True):
                seen, rows, held = 0, [], 0
                for headers, block in read_archive(data.as_buffer()):
                    seen += 1
                    rows.append(page_of(headers, block))
                    held += len(block)
                    if held >= 1 << 22:
                        yield _rows(rows)
                        rows, held = [], 0
                if seen != n.as_py():
                    raise BadArchive(f"{name} holds {seen} records and should hold {n}")
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(parse, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: the records, as ``read_archives`` has them.

    A null html is an empty payload, a null url has no target header; of rows with the largest page_id of
    a payload all are responses (repeated rows); pages with a null page_id come back with null;
    an empty table gives an empty result; other columns are ignored.  Control characters of a url come
    back percent-encoded.
    """
    scratch = Scratch(spark, "warc")
    return read_archives(spark, write_archives(spark, pages, scratch))
