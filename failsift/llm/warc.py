"""WARC archives: writing, and a sequential reader.

Every record is a gzip member of its own. The reader feeds a file to zlib in chunks, starts
anew where a member ends, frames the block by Content-Length and checks block and payload
digests, so it holds one record at a time. A record whose framing or digest is wrong comes
back with ``valid`` false; a file that breaks off inside a member raises ValueError.

Archives of other writers are read, too. Their record ids are kept as text and have no
``page_id``; record types other than response and revisit come back under their name, with the
block as payload unless it is an HTTP message. A digest that is absent or not SHA-1 is not
checked; SHA-1 may be in base 32 or in hex, and digests of other kinds are returned as they are.

Of the pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest
id is a response; the others are revisits that refer to it and carry the payload's digest and
length but not the payload. Pages are matched by narrow rows of digests. A task writes files of
its own names and returns them, and only returned files are read: a task that runs again
after a lost executor leaves no double records.

Files are reached through the file system that the folder's address names.

Defined cases: null html is the empty payload; null url leaves out the address. Pages without
id are responses unless an equal payload has an id. Rows that repeat the largest id are all
responses. No rows give no files and no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import small_batches, stored

LEAST_REVISIT = 1000
ROLL_BYTES = 256 << 20
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
# A list of revisits this long is some 80 MB as a hash table; a longer one is joined by a shuffle.
MAX_BROADCAST_REVISITS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _labelled(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


_OWN_URN = re.compile(r"<urn:page:(-?[0-9]{1,19})>")


def _page_of(urn: str | None) -> int | None:
    """The page of a record id of :func:`record`; other ids have none."""
    own = _OWN_URN.fullmatch(urn or "")
    page = int(own.group(1)) if own else None
    return page if page is not None and -(2**63) <= page < 2**63 else None


def _sha1_of(stated: str) -> bytes | None:
    """The bytes of a stated SHA-1, empty if it is none of the known forms; None for other digests."""
    kind, _, value = stated.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        found = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value, casefold=True)
    except ValueError:
        return b""
    return found if len(found) == 20 else b""


def _agrees(stated: str, data: bytes) -> bool:
    own = _sha1_of(stated)
    return own is None or own == hashlib.sha1(data).digest()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member holding one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    lines += [f"WARC-Payload-Digest: {_labelled(payload)}", f"WARC-Block-Digest: {_labelled(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one after the other."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                raise ValueError("the archive breaks off inside a record")
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(data: bytes) -> dict:
    """The fields of one record; ``valid`` tells whether its lengths and digests are right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = int(fields["content-length"]) if re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) else -1
    block = rest[: max(length, 0)]
    kind = fields.get("warc-type")
    revisit, http = kind == "revisit", fields.get("content-type", "").lower().startswith("application/http")
    http_head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = fields.get("warc-payload-digest", "")
    digest = _sha1_of(stated)
    length_field = _fields(http_head).get("content-length", "") if kind in ("response", "revisit") else ""
    stated_length = int(length_field) if re.fullmatch(r"[0-9]{1,18}", length_field) else None
    valid = (
        head.startswith(b"WARC/")
        and length >= 0
        and rest[length:] == b"\r\n\r\n"
        and _agrees(fields.get("warc-block-digest", ""), block)
        and digest != b""
        and (revisit or (_agrees(stated, payload) and stated_length in (None, len(payload))))
    )
    return {
        "page_id": _page_of(fields.get("warc-record-id")),
        "record_id": fields.get("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload": None if revisit else payload,
        "payload_bytes": stated_length if stated_length is not None or revisit else len(payload),
        "payload_digest": (digest.hex() if digest else stated or None) if valid else None,
        "refers_to": _page_of(fields.get("warc-refers-to")),
        "valid": valid,
    }


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to and revisit for every page."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = stored(
        pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
        .where(F.col("n") >= LEAST_REVISIT)
        .drop("n"),
        "warc-digests",
    )
    kept = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    revisits = stored(
        narrow.join(kept, "digest")
        .where("refers_to IS NOT NULL AND (page_id IS NULL OR page_id != refers_to)")
        .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
        .distinct(),
        "warc-revisits",
    )
    few = revisits.count() <= MAX_BROADCAST_REVISITS
    given = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    return given.join(
        F.broadcast(revisits) if few else revisits,
        F.col("page_id").eqNullSafe(F.col("r_page")) & (F.sha1("payload") == F.col("r_digest")),
        "left",
    ).select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages to archives in ``folder``; returns (path, records) of the files that count."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        stream, path, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = files.open_output_stream(path, compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"])
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= ROLL_BYTES:
                    stream.close()
                    done.append((path.rpartition("/")[2], records))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path.rpartition("/")[2], records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"]
        )

    return stored(with_revisits(pages).mapInArrow(write, "path string, records long"), "warc-files")


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("valid", pa.bool_()),
    ]
)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the listed files; one task per file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        row = parse(data)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(data) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    number = max(1, manifest.count())
    return manifest.select("path").repartition(number).mapInArrow(
        read,
        "page_id long, record_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
        "refers_to long, valid boolean",
    )
