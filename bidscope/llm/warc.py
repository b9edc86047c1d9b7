"""WARC records in ZIP-packaged archives: written as stored members with an index, read back by ranges.

An archive is a ZIP file with ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (one line per record with its offset and length), both stored without further
compression, so any record is a byte range of the archive. The reader finds the members through the ZIP
directories (with their ZIP64 forms) and never unpacks an archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from bidscope.session import shared_folder

ARCHIVE_BYTES = 64 << 20  # an archive is closed when its records reach this size
DATE = "2000-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures, sizes and limits of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32, EXTRA64, MAX_COMMENT = 0xFFFF, 0xFFFFFFFF, 1, 0xFFFF


# --- records


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: line breaks and other control characters are percent-encoded."""
    return quote(value, safe="".join(map(chr, range(33, 127)))) if not value.isprintable() or " " in value else value


def record_of(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[bytes, str]:
    """The WARC record of a page, and its type: a revisit if an equal payload belongs to the page ``first``.

    A revisit holds the HTTP head alone; its Content-Length is that of the full payload.
    """
    digest = digest_of(payload)
    kind = "response" if first == page_id else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {_line(url)}"] if url else [])]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n", kind


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(raw: bytes) -> dict:
    """Page, payload size and digest, type, reference and payload (None for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(http)["content-length"])
    if kind == "response" and (size != len(payload) or digest != digest_of(payload)):
        raise ValueError(f"damaged record {warc['warc-record-id']}")
    return {
        "page_id": _page(warc["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(warc.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


# --- ZIP archives


@dataclass
class Member:
    name: str
    method: int
    size: int  # bytes in the archive
    at: int  # offset of the local header
    crc: int = 0


@dataclass
class ZipWriter:
    """Writes stored members to a stream; sizes and offsets take the ZIP64 form where they need it."""

    out: pa.NativeFile
    members: list[Member] = field(default_factory=list)
    at: int = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Starts a member of unknown size; a descriptor with 64-bit sizes follows its bytes."""
        self.members.append(Member(name, 0, 0, self.at))
        extra = struct.pack("<HHQQ", EXTRA64, 16, 0, 0)
        raw = name.encode()
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        member = self.members[-1]
        member.size += len(data)
        member.crc = zlib.crc32(data, member.crc)
        self._put(data)

    def end(self) -> None:
        member = self.members[-1]
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", member.crc, member.size, member.size))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            extra = struct.pack("<HHQQQ", EXTRA64, 24, m.size, m.size, m.at)
            raw = m.name.encode()
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, m.crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        size, end64, n = self.at - start, self.at, len(self.members)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        self.out.close()


def read_range(file: pa.NativeFile, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"archive ends at {at + len(data)}, {size} bytes from {at} were asked for")
    return data


def members_of(file: pa.NativeFile) -> list[Member]:
    """The members of an archive from its central directory; plain and ZIP64 archives, any comment."""
    total = file.size()
    tail_at = max(0, total - 22 - MAX_COMMENT - 20)
    tail = read_range(file, tail_at, total - tail_at)
    whole = lambda i: i + 22 <= len(tail) and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail)
    end = tail.rfind(END)
    while end >= 0 and not whole(end):  # the signature may also stand in the comment
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no ZIP directory")
    n, size, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        raw = read_range(file, end64, 56)
        if raw[:4] != END64:
            raise ValueError("no ZIP64 directory where its locator points")
        n, size, at = struct.unpack_from("<QQQ", raw, 32)
    directory, found, i = read_range(file, at, size), [], 0
    for _ in range(n):
        if directory[i : i + 4] != CENTRAL:
            raise ValueError("damaged ZIP directory")
        method, crc, packed, unpacked, names, extras, comments, local = struct.unpack_from("<10xH4xIIIHHH8xI", directory, i)
        name = directory[i + 46 : i + 46 + names].decode()
        j, stop = i + 46 + names, i + 46 + names + extras
        while j + 4 <= stop:
            kind, length = struct.unpack_from("<HH", directory, j)
            if kind == EXTRA64:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", directory, j + 4))
                unpacked = next(wide) if unpacked == FULL32 else unpacked
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            j += 4 + length
        found.append(Member(name, method, packed, local, crc))
        i = stop + comments
    return found


def data_start(file: pa.NativeFile, member: Member) -> int:
    head = read_range(file, member.at, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no member at {member.at}")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.at + 30 + names + extras


# --- jobs


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row (``page_id, url, payload, first``) and returns the archives' table.

    Every task writes archives of its own under fresh names, so a task that runs again never meets files
    of its first try. The table of archives is itself written by Spark and lists those of finished tasks
    alone; files of lost tasks are in no table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive, index, path = None, [], ""

        def close() -> pa.RecordBatch:
            archive.end()
            archive.begin(INDEX)
            for line in index:
                archive.add(line)
            archive.end()
            archive.close()
            return pa.record_batch([[path], [len(index)], [archive.at]], names=["archive", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch[c] for c in ("page_id", "url", "payload", "first"))):
                if archive is None:
                    path = f"{uuid.uuid4().hex}.zip"
                    archive, index = ZipWriter(store.open_output_stream(f"{base}/{path}")), []
                    archive.begin(DATA)
                page_id, url = page_id.as_py(), url.as_py()
                raw, kind = record_of(page_id, url, payload.as_py() or b"", first.as_py())
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                entry = {"page": page_id, "type": kind, "offset": archive.members[-1].size, "length": len(packed)}
                index.append(f"{_line(url or '-')} {DATE} {json.dumps(entry)}\n".encode())
                archive.add(packed)
                if archive.members[-1].size >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    table = f"{folder.rstrip('/')}/archives.parquet"
    wanted = pages.select("page_id", "url", "payload", "first")
    wanted.mapInArrow(run, "archive string, records bigint, bytes bigint").write.parquet(table)
    return pages.sparkSession.read.parquet(table)


def _ranges(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """Offset and length of every record; the index is read a block at a time."""
    by_name = {m.name: m for m in members_of(file)}
    data, index = by_name[DATA], by_name[INDEX]
    if data.method or index.method:
        raise ValueError("only stored members can be read by ranges")
    start, at, rest = data_start(file, data), data_start(file, index), b""
    stop = at + index.size
    while at < stop:
        step = min(1 << 20, stop - at)
        *lines, rest = (rest + read_range(file, at, step)).split(b"\n")
        at += step
        for line in lines:
            entry = json.loads(line.split(b" ", 2)[2])
            yield start + entry["offset"], entry["length"]


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``.

    The payload of a response is checked against its digest; a revisit's payload is null, its size and
    digest are those of the full payload. Archives are dealt out over the tasks; a task holds one record
    and a block of an index at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for name in batch["archive"]:
                with store.open_input_file(f"{base}/{name.as_py()}") as file:
                    for at, length in _ranges(file):
                        rows.append(parse_record(zlib.decompress(read_range(file, at, length), 31)))
                        held += rows[-1]["payload_bytes"] + 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = min(max(1, archives.count()), 32 * archives.sparkSession.sparkContext.defaultParallelism)
    dealt = archives.select("archive").repartition(tasks)
    return dealt.mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    )


def with_first(pages: DataFrame) -> DataFrame:
    """Adds ``payload`` and ``first``, the smallest page_id with an equal payload.

    Payloads meet as SHA-1 digests with their smallest page only. Pages of unique payloads are their own
    first; only the digests that occur twice are joined back, and a digest that a large part of the pages
    shares is split by the engine's skew join.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.filter(F.col("_n") > 1).drop("_n")
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", F.coalesce("_first", "page_id").alias("first"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Packs all pages into archives in the shared folder, reads them back and returns a row per page.

    A null html is an empty payload; empty payloads revisit each other like any others. Rows that repeat
    the smallest page_id of a payload are all responses. Pages without an id revisit the smallest id with
    the same payload, and are responses where there is none. Other columns are left out.
    """
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/bidscope/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    return read_archives(write_archives(with_first(pages), folder), folder).drop("payload")
