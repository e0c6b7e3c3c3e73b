"""WARC archives compressed with Zstandard, a dictionary per archive, written and read by executors.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on
records of that archive; each record follows as a frame of its own, compressed with it.  Of equal
payloads of at least ``min_bytes`` bytes one record is a response, the others are revisits that name it and carry no payload.

Executors write files through pyarrow's file systems, so the folder may be on any store it reaches.
Each attempt of a task uses names of its own and returns a manifest row per finished archive; the
manifest is stored by Spark, which keeps one attempt's rows, and readers open only the files in it.
A task holds one archive's first records (``SAMPLE_BYTES`` and ``SAMPLE_RECORDS``) and one record at a time.

Defined results: null html is an empty payload; a null url has no target header; among rows
repeated with the largest id of a group each is a response; a null id ranks below all and reads back as null; an archive with too few
records to train on has a dictionary of their beginnings as they are; an empty table writes nothing and reads as no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored
from tallyspark.llm.text_arrays import map_texts

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records and raw bytes of them that an archive's dictionary is built from, both at least; raw bytes that end an archive.
SAMPLE_RECORDS, SAMPLE_BYTES, ARCHIVE_BYTES = 16, 4 << 20, 64 << 20
#: A dictionary learns from slices of each sampled record, from all over it, of this length in all, so that no record outweighs the rest.
LEARN_BYTES = 16 << 10
#: A dictionary, and a record's share of an untrained one, have this many bytes at least, where the records do.
LEAST_BYTES = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:tally:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit's block is the HTTP header alone, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<{RECORD}{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from slices of records; where they are too few for training, or have nothing in common, their beginnings as they are."""
    part = LEARN_BYTES // 4
    samples = [s if len(s) <= LEARN_BYTES else b"".join(s[k * (len(s) - part) // 3 :][:part] for k in range(4)) for s in samples]
    size = min(DICTIONARY_BYTES, max(LEAST_BYTES, sum(map(len, samples)) // 8))
    if len(samples) >= SAMPLE_RECORDS:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(size, samples, k=512, d=8)
    each = max(LEAST_BYTES, size // len(samples))
    return zstandard.ZstdCompressionDict(b"".join(s[:each] for s in samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """An open archive: keeps the first records back until the dictionary is built from them."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.level = sink, level
        self.held: list[bytes] | None = []
        self.raw = self.records = self.written = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.raw += len(record)
        self.records += 1
        if self.held is None:
            self._frame(record)
            return
        self.held.append(record)
        if self.raw >= SAMPLE_BYTES and (self.records >= SAMPLE_RECORDS or self.raw >= 4 * SAMPLE_BYTES):
            self._start()

    def _start(self) -> None:
        held, self.held = self.held or [], None
        made = train_dictionary(held)
        data = made.as_bytes()
        self._write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=made, write_content_size=True, write_checksum=True)
        for record in held:
            self._frame(record)

    def _frame(self, record: bytes) -> None:
        self._write(self.compressor.compress(record))

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def close(self) -> None:
        if self.held:
            self._start()
        self.sink.close()


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, one at a time."""
    start = source.read(8)
    made, lead = None, start
    if len(start) == 8:
        magic, size = struct.unpack("<II", start)
        if magic == DICTIONARY_MAGIC:
            made, lead = zstandard.ZstdCompressionDict(source.read(size)), b""
    reader = zstandard.ZstdDecompressor(dict_data=made).stream_reader(_Joined(lead, source), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield headers, block


class _Joined:
    """A file whose first bytes were read already."""

    def __init__(self, lead: bytes, source):
        self.lead, self.source = lead, source

    def read(self, n: int = -1) -> bytes:
        if self.lead:
            out, self.lead = self.lead, b""
            return out
        return self.source.read(n)


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it, so that executors resolve it as Spark does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified folder; a local one is written ``file:/...``."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write each row as a record below ``folder``; a lazy manifest (path, records, raw_bytes, bytes), to be stored once."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    folder = _qualified(pages.sparkSession, folder)
    groups = rows.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null").select("digest", "response")
    # Stored, so that both sides of the join are plain shuffles and Spark can split a very common page.
    marked = rows.join(stored(groups, "warc-groups"), "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        context, k, archive, path = TaskContext.get(), 0, None, ""

        def finish() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [archive.records], "raw_bytes": [archive.raw], "bytes": [archive.written]})

        for batch in batches:
            for page_id, url, body, refers_to in zip(*(batch.column(c).to_pylist() if c != "payload" else batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                body = body.as_py()
                if archive is None:
                    path = f"{root}/part-{context.partitionId():06d}-{k:04d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    archive = ArchiveWriter(files.open_output_stream(path, compression=None))
                archive.add(record_bytes(page_id, url, body, base32_sha1(body), refers_to, refers_to is not None, date))
                if archive.raw >= ARCHIVE_BYTES and archive.records >= SAMPLE_RECORDS:
                    yield finish()
                    archive, k = None, k + 1
        if archive is not None:
            yield finish()

    return map_texts(marked, run, "path string, records long, raw_bytes long, bytes long")


def read_archives(manifest: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """A row per record of the archives in a stored manifest.

    page_id, payload_bytes, payload_digest, record_type, refers_to and url; a response's digest is taken anew from
    its payload and must equal its header's.
    """
    parts, folder = parts or max(1, min(manifest.count(), 20000)), _qualified(manifest.sparkSession, folder)
    number = lambda x: None if x is None or x.endswith("null>") else int(x[len(RECORD) + 1 : -1])
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found: list[tuple] = []
                with files.open_input_stream(path, compression=None) as source:
                    for headers, block in read_archive(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"a payload in {path} doesn't match its digest")
                        found.append((number(headers["WARC-Record-ID"]), size, digest, kind, number(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI")))
                        if len(found) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    spread = manifest.select("path").repartition(parts)
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
