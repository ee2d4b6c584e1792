"""WARC archives in Zstandard: a writer, and a reader that decodes one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

# Fixed values of the two formats.
SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{page}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http if refers_to is not None else http + payload)


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary, or nothing where there is too little to learn from."""
    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes archives of about ``archive_bytes`` each, the dictionary in a skippable frame ahead of the records."""

    def __init__(self, folder: str, stem: str, archive_bytes: int, dict_bytes: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.stem, self.most, self.dict_bytes, self.level = stem, archive_bytes, dict_bytes, level
        self.pending: list[bytes] = []
        self.size = self.count = 0
        self.dict: bytes | None = None
        self.out = None
        self.done: list[tuple[str, int]] = []

    def add(self, rec: bytes) -> None:
        if self.dict is None:
            self.pending.append(rec)
            self.size += len(rec)
            if len(self.pending) < 400 and self.size < 4 << 20:
                return
            self.learn()
        else:
            self.put(rec)

    def learn(self) -> None:
        self.dict = train([r[: 64 << 10] for r in self.pending], self.dict_bytes)
        pending, self.pending, self.size = self.pending, [], 0
        for r in pending:
            self.put(r)

    def put(self, rec: bytes) -> None:
        if self.out is None:
            self.name = f"{self.stem}-{len(self.done):05d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.size = self.count = 0
            data = zstandard.ZstdCompressionDict(self.dict) if self.dict else None
            self.zstd = zstandard.ZstdCompressor(level=self.level, dict_data=data, write_content_size=True, write_checksum=True)
            if self.dict:
                packed = zstandard.ZstdCompressor(level=19).compress(self.dict)
                self.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{self.name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self.write(self.zstd.compress(info))
        self.write(self.zstd.compress(rec))
        self.count += 1
        if self.size >= self.most:
            self.roll()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.count))
            self.out = None

    def close(self) -> None:
        if self.dict is None and self.pending:
            self.learn()
        self.roll()


def mark_revisits(pages: DataFrame, scratch: Scratch, min_payload: int) -> DataFrame:
    """Adds refers_to: of rows with equal payloads the largest page_id, for the others of them.

    Payloads meet by hash and id alone, so no common payload gathers the rows that hold it: tables of their own let Spark
    split a hot hash, and the payloads are joined by (id, hash), which no number of rows shares.
    """
    keyed = pages.withColumn("k", F.sha2(F.col("payload"), 256))
    ids = keyed.where(F.length("payload") >= min_payload).select("page_id", "k")
    first = ids.groupBy("k").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1").select("k", "top")
    first = scratch.save(first, "first")
    later = scratch.save(ids.join(first, "k").where("page_id < top").distinct(), "revisits")
    return keyed.join(later, ["page_id", "k"], "left").select("page_id", "url", "payload", F.col("top").alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0, archive_bytes: int = 64 << 20, dict_bytes: int = 32 << 10, level: int = 3) -> DataFrame:
    """Writes one record for each row and returns the archives: uri and records.

    Of rows with equal payloads of at least ``min_payload`` bytes the one with the largest id is a response and the
    others revisit it; rows that share that id too are responses all. A null payload is empty, a null URL has no
    target header, white space in a URL becomes one blank (a header is one line), a row with a null id revisits nothing and keeps its payload. Files of failed attempts have names
    of their own and stand in no returned row. An empty table gives no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = scratch.path("warc")
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        out = ArchiveWriter(folder, f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}", archive_bytes, dict_bytes, level)
        for b in batches:
            for page, url, payload, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.add(page_record(page, url, payload, sha1_base32(payload), to))
        out.close()
        names = [f"{folder}/{n}" for n, _ in out.done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c for _, c in out.done], pa.int64())], ["uri", "records"])

    return scratch.save(mark_revisits(src, scratch, min_payload).mapInArrow(run, "uri string, records long"), "archives")


# ---------------------------------------------------------------- reading


def frames(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame; a dictionary ahead of them is loaded first."""
    data = stream.read(8)
    dict_data = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame ends early")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != DICT_MAGIC:
            raise WarcError("the skippable frame holds no dictionary")
        dict_data, data = zstandard.ZstdCompressionDict(raw), b""
    zstd = zstandard.ZstdDecompressor(dict_data=dict_data)
    while data or (data := stream.read(chunk)):
        if len(data) < 4 and len(more := stream.read(chunk)):
            data += more
        if data[:4] != FRAME_MAGIC:
            raise WarcError("no frame starts here")
        one, parts = zstd.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                break
            if not (data := stream.read(chunk)):
                raise WarcError("a frame ends early")
        data = one.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, validated."""
    head, sep, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no header {need}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != CRLF + CRLF:
        raise WarcError("the block's length isn't what its header says")
    return headers, rest[:-4]


def http_parts(block: bytes) -> tuple[int, bytes]:
    """Content-Length of the HTTP head, and what follows it."""
    head, sep, body = block.partition(CRLF + CRLF)
    lengths = [v for line in head.split(CRLF)[1:] for k, _, v in [line.partition(b":")] if k.strip().lower() == b"content-length"]
    if not sep or not head.startswith(b"HTTP/") or len(lengths) != 1 or not lengths[0].strip().isdigit():
        raise WarcError("no HTTP response")
    return int(lengths[0]), body


def page_number(uri: str) -> int | None:
    name = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "None" else int(name)


def read_record(raw: bytes) -> tuple | None:
    headers, block = parse(raw)
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    size, body = http_parts(block)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if len(body) != size:
            raise WarcError("the payload's length isn't what its header says")
        if sha1_base32(body) != digest:
            raise WarcError("the payload isn't what its digest says")
        to = None
    else:
        if body or "warc-refers-to" not in headers:
            raise WarcError("a revisit has no payload and refers to a record")
        to = page_number(headers["warc-refers-to"])
        body = None
    return page_number(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, headers["warc-type"], to, body


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each response and revisit of the archives at ``archives.uri``.

    An archive is read as a stream, a frame at a time. Damaged archives, wrong lengths and wrong digests raise
    ``WarcError``. A revisit's payload is null; an empty list of archives gives no rows.
    """
    ship(archives.sparkSession)
    schema = SCHEMA if with_payload else pa.schema([f for f in SCHEMA if f.name != "payload"])
    text = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(path) as stream:
                    for raw in frames(stream):
                        if (row := read_record(raw)) is not None:
                            rows.append(row[: len(schema)])
                            size += len(raw) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, min(2000, archives.count()))
    return archives.select("uri").repartition(n).mapInArrow(run, text)
