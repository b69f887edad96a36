"""WARC archives: writer and sequential reader.

Every record is one gzip member. Tasks write archives of a bounded size into the shared folder under names that
no other attempt uses and report them in a manifest; only reported archives are read, so a lost or repeated
task leaves at most an unread file. The reader decompresses incrementally, frames each record by its
Content-Length, and verifies block and payload digests without holding a record in memory.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Scratch, spread_join

#: Compressed bytes after which a task begins another archive.
ROLL_BYTES = 64 << 20
CHUNK = 1 << 16
#: Bytes in which a header ends.
HEAD_BYTES = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header, with the full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + END + block + END) + packer.flush()


def decompressed(stream) -> Iterator[bytes | None]:
    """Pieces of at most CHUNK bytes of each gzip member, None after each member."""
    pending = b""
    while True:
        pending = pending or stream.read(CHUNK)
        if not pending:
            return
        member = zlib.decompressobj(31)
        while not member.eof:
            if not pending:
                pending = stream.read(CHUNK)
                if not pending:
                    raise ValueError("truncated gzip member")
            piece = member.decompress(pending, CHUNK)
            pending = member.unused_data if member.eof else member.unconsumed_tail
            if piece:
                yield piece
        yield None


def fields(head: bytes) -> dict[str, str]:
    """Names in lower case and values of a header without its first line; a line that begins with a space goes on with the value before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def page(urn: str | None) -> int | None:
    """The page number of a record id of this writer, None where it has none."""
    number = (urn or "").strip("<>").removeprefix(URN)
    return int(number) if number.lstrip("-").isdigit() else None


class Digest:
    """A declared digest, ``algorithm:value`` in base32, base64 or hexadecimal; one that is missing or of an unknown algorithm fits anything."""

    def __init__(self, declared: str | None):
        name, _, self.value = (declared or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.value, self.sum = self.value.strip(), hashlib.new(name) if name in ("md5", "sha1", "sha256", "sha384", "sha512") else None

    def update(self, part: bytes) -> None:
        if self.sum is not None:
            self.sum.update(part)

    def fits(self) -> bool:
        if self.sum is None:
            return True
        own = self.sum.digest()
        return self.value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=") or self.value.lower() == own.hex() or self.value == base64.b64encode(own).decode()


def read_records(stream) -> Iterator[dict]:
    """The records of an archive in order, of any type and writer of WARC 1.0 and 1.1: record_id, record_type, date, target_uri, content_type, refers_to,
    payload_bytes, payload_digest.

    Ids and types are text, digests are checked where they are declared and the payload is whole and as it was sent. The payload of an HTTP message is what follows its
    header, that of any other record its block; payload_digest is the declared SHA-1 in base32, else that of the payload. A revisit has the length that its header states.
    A block is never held, a header up to HEAD_BYTES. Raises ValueError for bad framing or a digest that does not fit.
    """
    pieces = decompressed(stream)
    for piece in pieces:
        held, at = bytearray(), -1
        while at < 0:
            if piece is None or len(held) > HEAD_BYTES:
                raise ValueError("record without a header")
            held += piece
            at = held.find(END, max(0, len(held) - len(piece) - 3))
            piece = next(pieces) if at < 0 else piece
        if not held.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        warc, rest = fields(bytes(held[:at])), bytes(held[at + 4 :])
        left = int(warc["content-length"])
        block, payload, own, size = Digest(warc.get("warc-block-digest")), Digest(warc.get("warc-payload-digest")), hashlib.sha1(), 0
        http, tail = bytearray(), b""
        inside = not warc.get("content-type", "").lower().startswith("application/http")
        while True:
            part, tail = rest[:left], tail + rest[left:]
            left -= len(part)
            block.update(part)
            if not inside:
                http += part
                cut = http.find(END, max(0, len(http) - len(part) - 3))
                if cut < 0 and len(http) <= HEAD_BYTES:
                    part = b""
                else:  # a header that is too long is none
                    inside, part, http = True, bytes(http[cut + 4 :]) if cut >= 0 else bytes(http), http[: cut + 2] if cut >= 0 else bytearray()
            payload.update(part)
            own.update(part)
            size += len(part)
            if len(tail) > len(END):
                break
            rest = next(pieces)
            if rest is None:
                break
        if left or tail != END:
            raise ValueError("content length does not fit the record")
        header, kind = fields(bytes(http)), warc.get("warc-type", "")
        if not block.fits():
            raise ValueError("block digest does not fit")
        complete = kind != "revisit" and "warc-truncated" not in warc and "warc-segment-number" not in warc and "transfer-encoding" not in header
        if complete and not payload.fits():
            raise ValueError("payload digest does not fit")
        declared = warc.get("warc-payload-digest", "")
        stated = header.get("content-length", "")
        yield {
            "record_id": warc.get("warc-record-id"),
            "record_type": kind,
            "date": warc.get("warc-date"),
            "target_uri": warc.get("warc-target-uri"),
            "content_type": warc.get("content-type"),
            "refers_to": warc.get("warc-refers-to"),
            "payload_bytes": int(stated) if kind == "revisit" and stated.isdigit() else size,
            "payload_digest": declared[5:] if declared.lower().startswith("sha1:") else base64.b32encode(own.digest()).decode(),
        }


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_archives(scratch: Scratch, pages: DataFrame, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes).

    Of records whose payloads are equal and have ``least_bytes`` or more, that with the largest page_id is a response and
    the others revisit it; rows without a page_id revisit too but are never referred to. Null html is an empty payload, a
    null url an empty one; bytes that are not UTF-8 are written as they are. Rows that repeat the largest page_id are responses all.
    A task begins another archive after ``roll_bytes``. Payloads of a heavy digest do not move: its keeper is brought to them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("n", F.octet_length("html"))
    shared = rows.groupBy("sha", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("m")).where((F.col("m") > 1) & (F.col("n") >= least_bytes) & F.col("keeper").isNotNull())
    shared = scratch.write(shared, "shared")
    placed = spread_join(rows, shared, ["sha", "n"], "left").select("page_id", F.col("url").cast("binary").alias("url"), "html", "keeper")
    folder = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(folder)
        out, path, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            nonlocal out, records, size
            if out is not None:
                out.close()
                done.append((path, records, size))
                out, records, size = None, 0, 0

        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                for page_id, url, html, keeper in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        files.create_dir(root, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path = f"{folder}/{name}"
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    record = encode_record(page_id, None if url is None else url.decode("utf-8", "replace"), html, keeper, keeper is not None and page_id != keeper)
                    out.write(record)
                    records, size = records + 1, size + len(record)
                    if size >= roll_bytes:
                        finish()
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return scratch.write(placed.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of every archive of the manifest, verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = open_fs(path)
                with files.open_input_stream(name, compression=None) as stream:
                    held = []
                    for r in read_records(stream):
                        held.append({**r, "page_id": page(r["record_id"]), "refers_to": page(r["refers_to"]), "url": r["target_uri"]})
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    archives = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(archives).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url. No rows for an empty table."""
    return read_archives(write_archives(Scratch(spark, "warc"), pages))


ORACLE = """
with p as (select page_id, coalesce(url, '') url, coalesce(html, '') html from pages),
d as (select *, sha1(html) h, octet_length(encode(html)) n, max(page_id) over (partition by html) keeper, count(*) over (partition by html) m from p),
g as (select d.*, (select string_agg(c, '' order by k) from (
  select k, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1) c from range(32) r(k))) digest from d)
select page_id, n::bigint payload_bytes, digest payload_digest,
  case when m > 1 and page_id <> keeper then 'revisit' else 'response' end record_type,
  case when m > 1 and page_id <> keeper then keeper end refers_to, url
from g
"""
