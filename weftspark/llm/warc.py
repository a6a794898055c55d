"""Deduplicated WARC archives: revisit records for payloads that another record holds already.

Headers (page_id and payload digest) are dealt by payload digest, without the payloads; the smallest page_id of a digest
is the original response and all others become revisit records that refer to it.  The digests that are found more than
once are joined back to the pages: by a broadcast if a count says that they are few, so that no page moves; by a
shuffle of the pages, safe against hot digests, if they are many.  Archives are then written with fresh headers,
revisits without a payload, and read back record by record; a revisit whose response isn't there is an error.

Archives are ``.warc.gz`` files of one gzip member a record and at most about ``ARCHIVE_BYTES``, which the executors
write into a shared folder.  A file is named after its content, written under a passing name and renamed; the table of
archives that Spark commits lists the files that count, so a lost executor leaves at most a file that nobody reads.
Where the folder's store can't be opened from Python, archives are rows of that table instead (``content``).

Defined cases: a null html is an empty payload, and a null url an empty target; payloads of fewer than ``least`` bytes
are always responses; records that share the smallest page_id of a payload (repeated rows) are all responses; a null
page_id is written as an empty id, read back as null, and never referred to unless no other page has that payload,
in which case all are responses; a very long payload makes its archive as long; an empty table gives no archives and an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ._cluster import BROADCAST_ROWS, Staged, lookup

#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes given to the decompressor at once: what follows a member's end is copied, so this bounds that copy.
SLICE = 16 << 10
#: Tasks that read archives, at most.
READERS = 20_000
_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs in RFC 4122


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, hashed: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url.translate({13: '%0D', 10: '%0A'})}",
        f"WARC-Payload-Digest: sha1:{hashed}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[4:4] = [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with a fixed header, so that equal records give equal bytes."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_records(archive: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, member after member, in time linear in the archive's size."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    left = stream.read(SLICE)
    while left:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not left:
                raise ValueError("an archive ends inside a record")
            parts.append(z.decompress(left))
            left = z.unused_data or stream.read(SLICE)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if fields["WARC-Block-Digest"] != "sha1:" + digest(block):
            raise ValueError("a record's block is damaged")
        yield fields, block


def resolve(pages: DataFrame, staged: Staged, least: int = 0) -> DataFrame:
    """page_id, url, html (binary), its SHA-1 and, for revisits, refers_to."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    hashed = rows.withColumn("payload", F.unhex(F.sha1("html")))
    headers = hashed.filter(F.octet_length("html") >= least).select("payload", "page_id")
    originals = headers.groupBy("payload").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("records"))
    originals = staged.write(originals.filter("records > 1 and first is not null"))
    found, total = originals.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0))).first()
    if found <= BROADCAST_ROWS:
        out = hashed.join(F.broadcast(originals.select("payload", "first")), "payload", "left")
    else:
        out = lookup(hashed, originals, "payload", "records", total)
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()) & (F.octet_length("html") >= least)
    return out.select("page_id", "url", "html", "payload", F.when(again, F.col("first")).alias("refers_to"))


def open_store(folder: str) -> tuple[stores.FileSystem, str] | None:
    """The store of a folder's URI and the path in it; None where Python has no access to such a store."""
    try:
        return stores.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _put(folder: str, name: str, content: bytes) -> None:
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    passing = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(passing, compression=None) as out:
        out.write(content)
    store.move(passing, f"{path}/{name}")


_ARCHIVE = pa.schema([("name", pa.string()), ("folder", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("content", pa.binary())])
_ARCHIVE_SQL = "name string, folder string, records long, bytes long, content binary"


def _write(folder: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    held = n = 0

    def archive() -> pa.RecordBatch:
        whole = b"".join(parts)
        name = f"{hashlib.sha256(whole).hexdigest()[:24]}.warc.gz"
        if folder is not None:
            _put(folder, name, whole)
        return pa.RecordBatch.from_pylist([{"name": name, "folder": folder, "records": n, "bytes": len(whole), "content": None if folder is not None else whole}], _ARCHIVE)

    for batch in batches:
        for row in range(batch.num_rows):
            page_id, url, html, sha, refers_to = (batch.column(c)[row].as_py() for c in range(5))
            parts.append(member(record(page_id, url, html, base64.b32encode(sha).decode(), refers_to)))
            held, n = held + len(parts[-1]), n + 1
            if held >= ARCHIVE_BYTES:
                yield archive()
                parts, held, n = [], 0, 0
    if parts:
        yield archive()


def write_archives(pages: DataFrame, staged: Staged, least: int = 0, folder: str | None = None) -> DataFrame:
    """name, folder, records, bytes and content (null where it is a file) of the archives, written by the executors.

    ``folder`` is a URI that the driver and all executors see; unless given, one in the shared folder.
    """
    ship(pages.sparkSession)
    folder = folder or f"{staged.base}/archives"
    into = folder if open_store(folder) else None
    return staged.write(resolve(pages, staged, least).mapInArrow(lambda it: _write(into, it), _ARCHIVE_SQL))


def _get(name: str, folder: str | None, content: bytes | None) -> BinaryIO:
    if content is not None:
        return io.BytesIO(content)
    store, path = open_store(folder)
    return store.open_input_stream(f"{path}/{name}", compression=None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive"]
    for batch in batches:
        for row in range(batch.num_rows):
            name, folder, content = (batch.column(c)[row].as_py() for c in range(3))
            out = []
            with _get(name, folder, content) as stream:
                for fields, block in read_records(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    kind, hashed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or digest(payload) != hashed):
                        raise ValueError("a record's payload is damaged")
                    refers = fields.get("X-Refers-To-Page-ID")
                    out.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, size, hashed, kind, int(refers) if refers else None, fields["WARC-Target-URI"], name))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _spread(archives: DataFrame) -> DataFrame:
    """A task for each archive, as their table is small but what it lists isn't."""
    return archives.repartition(max(1, min(READERS, archives.count())))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, archive."""
    ship(archives.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string"
    return _spread(archives.select("name", "folder", "content")).mapInArrow(_read, schema)


def _copy(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            with _get(*(batch.column(c)[row].as_py() for c in range(3))) as stream:
                _put(folder, batch.column(0)[row].as_py(), stream.read())
        yield batch.select([0])


def export(archives: DataFrame, folder: str) -> int:
    """Copy all archives into a folder that the executors see, in parallel; how many there are."""
    ship(archives.sparkSession)
    return _spread(archives.select("name", "folder", "content")).mapInArrow(lambda it: _copy(folder, it), "name string").count()


def verified(records: DataFrame, staged: Staged) -> DataFrame:
    """``records``, if each revisit refers to a response among them with the same payload digest and length."""
    rows = staged.write(records)
    named = rows.groupBy("payload_digest", "payload_bytes", F.coalesce("refers_to", "page_id").alias("named"))
    lost = named.agg(F.count_if(F.col("record_type") == "revisit").alias("revisits"), F.count_if(F.col("record_type") == "response").alias("responses")).filter("revisits > 0 and responses = 0")
    if (found := lost.first()) is not None:
        raise ValueError(f"{found['revisits']} revisits refer to page {found['named']}, whose response isn't in the archives")
    return rows


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html), read them back and check what refers to what."""
    staged = Staged(pages.sparkSession, "warc")
    return verified(read_archives(write_archives(pages, staged, least)), staged)
