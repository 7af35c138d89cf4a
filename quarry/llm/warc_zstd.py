"""WARC archives whose records are compressed one by one against an embedded Zstandard dictionary.

Each task writes its pages as archive files (``*.warc.zst``). The first records
of a file, at most ``SAMPLE_BYTES`` of them, train the file's dictionary; it
stands, itself compressed, in a skippable frame at the head of the file, and
every record is a frame of its own that refers to it. So any record can be
read from its offset and the dictionary alone. A file is closed at
``FILE_BYTES`` and put in place by a rename, under a name that holds the task's
attempt: a task that is run again leaves no half-written file in the manifest.

Equal payloads (by SHA-256) of at least ``REVISIT_BYTES`` are stored once: the
page of the smallest page_id is a response, the others are revisit records that
keep their HTTP head and name the response. Shorter payloads are responses all.

Scale: the least id per digest is summed map-side and joined back by digest,
the side of the pages being splittable where one payload is very common. A task
holds the training sample and one record. Reading goes file by file.

Edge cases: a null html is an empty payload; a null url an empty target. Rows
that repeat the smallest page_id are responses each. Among rows without any id,
equal payloads have no smallest id and are responses; beside rows with ids they
are revisits. An empty table makes no file and an empty result. Line ends in a
url are percent-encoded. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh_path, steps, written

#: Of the WARC-in-Zstandard format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 128 << 20
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id, content: str = "") -> str:
    """The same on every attempt of a task: from the page's id or, where there is none, from what the record holds."""
    name = f"page:{page_id}" if page_id is not None else f"content:{content}"
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def warc_record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if refers_to is given."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, f'{target} {digest}')}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = lambda part: dict(x.split(": ", 1) for x in part.decode("utf-8").split("\r\n")[1:] if ": " in x)
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the samples; of few or tiny ones, the samples themselves as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to one file; the dictionary is made when the sample is full or the file ends."""

    def __init__(self, uri: str, level: int = 3):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.part, self.level = self.path + ".part", level
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.held, self.held_bytes, self.zip = self.fs.open_output_stream(self.part, compression=None), [], 0, None
        self.records = self.raw_bytes = self.bytes = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        trained = train_dictionary(self.held)
        packed = zstandard.ZstdCompressor(level=self.level).compress(trained.as_bytes())
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.zip = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=True, write_checksum=True)
        for r in self.held:
            self._put(self.zip.compress(r))
        self.held = []

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw_bytes += len(record)
        if self.zip is not None:
            self._put(self.zip.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if self.zip is None:
            self._start()
        self.out.close()
        self.fs.move(self.part, self.path)


def read_archive(uri: str, step: int = 1 << 20):
    """The records of a file, in order, decompressed one at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri} has no leading dictionary frame")
        raw = zstandard.ZstdDecompressor().decompress(f.read(size))
        kind = zstandard.DICT_TYPE_AUTO
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        frame, parts, data = None, [], b""
        while True:
            if not data:
                data = f.read(step)
                if not data:
                    break
            frame = frame or unzip.decompressobj()
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(parts)
                frame, parts = None, []
        if frame is not None:
            raise ValueError(f"{uri} ends within a record")


def with_references(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload and refers_to (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    long_enough = F.length("payload") >= REVISIT_BYTES
    first = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    joined = rows.join(first, "digest", "left")
    other = long_enough & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str) -> DataFrame:
    """Write pages (page_id, url, html) under out; path, records, raw_bytes and bytes of every file."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{out}/pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, done, n = None, [], 0
        for b in steps(batches, 2):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    writer = ArchiveWriter(f"{name}-{n:04d}.warc.zst")
                writer.add(warc_record(page_id, url, payload, refers_to))
                if writer.bytes >= FILE_BYTES:
                    writer.close()
                    done.append((f"{name}-{n:04d}.warc.zst", writer.records, writer.raw_bytes, writer.bytes))
                    writer, n = None, n + 1
        if writer is not None:
            writer.close()
            done.append((f"{name}-{n:04d}.warc.zst", writer.records, writer.raw_bytes, writer.bytes))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "raw_bytes", "bytes"])

    return written(with_references(pages).mapInArrow(run, "path string, records long, raw_bytes long, bytes long"), "manifest")


READ_SCHEMA = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


def read_archives(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """A row for every record of the files of a manifest; digests of responses are taken from the payload read."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for record in read_archive(path):
                    warc, http, payload = parse_record(record)
                    stored = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = warc["WARC-Type"] == "response"
                    if response and hashlib.sha256(payload).hexdigest() != stored:
                        raise ValueError(f"{path}: a payload does not have its digest")
                    size = len(payload) if response else int(http["Content-Length"])
                    rows.append((warc.get("WARC-Page-ID"), size, stored, warc["WARC-Type"], warc.get("WARC-Refers-To-Page-ID")))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = max(1, manifest.count())
    rows = manifest.select("path").repartition(files).mapInArrow(run, READ_SCHEMA.format(kind="string"))
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive_and_read(pages: DataFrame) -> DataFrame:
    out = fresh_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(write_archives(pages.select("page_id", "url", "html"), out), kind)
