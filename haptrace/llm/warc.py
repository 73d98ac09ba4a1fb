"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Of records with equal payloads of ``min_bytes`` or more, the one with the largest page id holds the
payload and the others are revisit records that refer to it (identical-payload-digest profile, with
the HTTP header but no payload). Equality is by length and SHA-256; only digests are grouped.

A task writes its rows into archives of its own in ``folder``, rolled at ``archive_bytes``, under names
that no other attempt uses; the checkpointed manifest lists the archives of the attempts that
counted, so lost executors and repeated tasks leave unread files at most. The folder must be one
that all executors share (any file system that pyarrow opens by URI). The reader goes through an
archive record by record: incremental decompression of one member, header up to the blank line, as
many bytes as Content-Length says, then block and payload digests are verified.

Defined results
* A null payload is empty; a null url leaves out the target URI; other columns are ignored.
* A null page id counts as smaller than any; of payloads that only null ids hold, all are responses.
* Repeated rows with the largest id are all responses, with smaller ids all revisits.
* An empty table writes no archive and reads back as no row. A broken digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from haptrace.session import cut_lineage

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one of the session."""
    cut_lineage(spark.range(1))  # sets the folder on a local master that has none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    plain = uri if "://" in uri or uri.startswith("file:") else f"file:{uri}"
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", plain))


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, head, head_url): head is the page that a revisit refers to."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    marks = rows.filter(F.length("payload") >= min_bytes).select("page_id", "url", digest.alias("digest"))
    first = F.max(F.struct("page_id", "url"))
    heads = marks.groupBy("digest").agg(first.alias("h"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("h.page_id").isNotNull())
    heads = cut_lineage(heads.select("digest", F.col("h.page_id").alias("head"), F.col("h.url").alias("head_url")))
    again = marks.join(heads, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") < F.col("head")))
    # Rows find their role by id and digest: ids differ where a payload's copies don't.
    again = again.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("__id"), "digest", "head", "head_url").distinct()
    keyed = rows.withColumns({"__id": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest": digest})
    return keyed.join(again, ["__id", "digest"], "left").select("page_id", "url", "payload", "head", "head_url")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_text(value: str) -> str:
    """A URL as one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, head: int | None, head_url: str | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if head is None else b"")
    name = f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(payload).digest()[:16])}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if head is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{head}>"]
        if head_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_text(head_url)}")
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(roles: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of ``with_roles`` rows; (path, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, records = None, "", 0
        for batch in batches:
            for page_id, url, payload, head, head_url in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{os.urandom(6).hex()}.warc.gz"
                    out, records = store.open_output_stream(f"{base}/{name}", compression=None), 0
                out.write(member(record(page_id.as_py(), url.as_py(), payload.as_py(), head.as_py(), head_url.as_py())))
                records += 1
                if out.tell() >= archive_bytes:
                    done.append((f"{folder}/{name}", records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{name}", records, out.tell()))
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    ordered = roles.select("page_id", "url", "payload", "head", "head_url")
    return cut_lineage(ordered.mapInArrow(run, "path string, records bigint, bytes bigint"))


class Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, file, first: bytes):
        self.file, self.unzip, self.packed, self.plain = file, zlib.decompressobj(31), first, bytearray()

    def more(self) -> bool:
        if self.unzip.eof:
            return False
        if not self.packed:
            self.packed = self.file.read(READ_BYTES)
        fresh = self.unzip.decompress(self.packed, READ_BYTES)
        if not self.packed and not fresh and not self.unzip.eof:
            raise EOFError("an archive ends inside a record")
        self.plain += fresh
        self.packed = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        at, seen = self.plain.find(mark), 0
        while at < 0:
            seen = max(0, len(self.plain) - len(mark))
            if not self.more():
                raise ValueError("a record has no end of header")
            at = self.plain.find(mark, seen)
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    def take(self, size: int) -> bytes:
        while len(self.plain) < size:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        found = bytes(self.plain[:size])
        del self.plain[:size]
        return found

    def end(self) -> bytes:
        """Checks the record's end and gives back what follows the member."""
        while self.more():
            pass
        if bytes(self.plain) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        return self.packed


def _fields(text: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in text.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, value in pairs}


def records(file) -> Iterator[dict]:
    """Records of an open archive: header fields, HTTP fields, payload, digests verified."""
    rest = file.read(READ_BYTES)
    while rest:
        part = Member(file, rest)
        header = part.until(b"\r\n\r\n")
        if not header.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(header)
        block = part.take(int(fields["content-length"]))
        rest = part.end() or file.read(READ_BYTES)
        if _sha1(block) != fields["warc-block-digest"]:
            raise ValueError(f"block digest of {fields['warc-record-id']} differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and _sha1(payload) != fields["warc-payload-digest"]:
            raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
        yield {"fields": fields, "http": _fields(http), "payload": payload}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


COLUMNS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
    "refers_to": pa.int64(), "payload": pa.binary(),
}
SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(manifest: DataFrame, payloads: bool = True, rows_at_once: int = 256) -> DataFrame:
    """Records of the manifest's archives, the digest as hexadecimal SHA-1; without ``payloads`` these are null."""

    def row(found: dict) -> tuple:
        fields, http = found["fields"], found["http"]
        kind = fields["warc-type"]
        size = len(found["payload"]) if kind == "response" else int(http["content-length"])
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        return (_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to")),
                found["payload"] if payloads and kind == "response" else None)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(COLUMNS.values())], names=list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for path in listed.column(0).to_pylist():
                store, name = open_folder(path)
                held: list[tuple] = []
                size = 0
                with store.open_input_stream(name, compression=None) as file:
                    for found in records(file):
                        held.append(row(found))
                        size += len(found["payload"])
                        if len(held) >= rows_at_once or size > 8 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    return manifest.select("path").mapInArrow(run, SCHEMA)
