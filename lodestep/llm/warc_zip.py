"""WARC records in ZIP archives, written by partition and read back by byte ranges.

An archive holds two stored members: the records, and an index of lines ``key
time {...}`` sorted by key, with the offset and length of each record in its
member.  The reader never extracts: it parses the end of the file, the central
directory and their ZIP64 forms, finds the stored members, reads the indexes, and
then reads each record's range.  Records may be gzipped one by one, as in stored
``.warc.gz`` members, and so may indexes.  Without an index that names every
member's records, members are scanned record by record.  A member of records that
the ZIP itself compresses or encrypts can't be read by ranges: it is an error, by
name.

Of pages with equal payloads the one of the smallest page id has the response;
the others are revisits of it (identical payload digest) and carry the response's
HTTP headers only.  Pages share a payload by its SHA-1.  Payloads below
``least_bytes`` are written each time.  Null html is an empty payload; a page
without an id is a revisit if some equal page has one; repeated rows of the
smallest id are responses each, of one record id, as they are one capture.  Line
ends in addresses are percent-encoded.  A table without rows writes no archive.

Files are written under another name and moved to their own, which follows from
partition and number, so that a task that runs again replaces what it left.
Paths are those that ``pyarrow.fs`` opens: file, hdfs, s3 and gs addresses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Scratch, ensure_importable

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A new archive is begun after so many bytes or records, ranges are read by tasks of about as many bytes, and so many are held at once.
ARCHIVE_BYTES, ARCHIVE_RECORDS, BLOCK_BYTES, HELD_BYTES = 1 << 30, 100_000, 64 << 20, 4 << 20
#: Digests of repeated payloads (28 bytes each) that are broadcast; beyond, pages are joined by a shuffle, whose hot partitions Spark splits.
BROADCAST_ROWS = 1_000_000
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, with its closing empty lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def url_key(url: str | None) -> str:
    """What an index sorts by: the host's labels from the last to the first, then path and query; the address itself if it has no host."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").split(".")
    except ValueError:
        host = [""]
    if host == [""]:
        return re.sub(r"\s", "%20", (url or "").lower()) or "-"
    return re.sub(r"\s", "%20", f"{','.join(reversed(host))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower())


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Output:
    """An archive that is being written."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str):
        self.files, self.path, self.draft = files, f"{folder}/{name}.zip", f"{folder}/.{name}-{uuid.uuid4().hex}.part"
        files.create_dir(folder, recursive=True)
        self.stream = files.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, data: bytes, page_id: int | None, url: str | None, digest: str, date: str) -> None:
        entry = {"url": one_line(url) if url is not None else None, "page_id": page_id, "digest": f"sha1:{digest}", "filename": DATA.rpartition("/")[2], "offset": self.size, "length": len(data)}
        self.lines.append(f"{url_key(url)} {re.sub('[^0-9]', '', date)} {json.dumps(entry)}")
        self.member.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode() + b"\n")
        self.zip.close()
        self.stream.close()
        self.files.move(self.draft, self.path)
        return self.path, self.size, len(self.lines)


def write(
    pages: DataFrame,
    folder: str,
    id_: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write archives to ``folder`` when the result, (archive, bytes, records), is computed; write that to a table once."""
    scratch = Scratch(pages.sparkSession, "digests")
    rows = pages.select(
        F.col(id_).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    # only digests and ids are gathered, and payloads stay where they are while the digests that repeat are few enough to broadcast
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1 and first is not null").select("sha", "first")
    firsts = scratch.table(firsts, "firsts")
    few = firsts.count() <= BROADCAST_ROWS
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.length("payload") >= least_bytes)
    rows = rows.join(F.broadcast(firsts) if few else firsts, "sha", "left").select("page_id", "url", "payload", "sha", "first", revisit.alias("revisit"))
    if not few:  # the order of rows that were shuffled isn't fixed
        rows = rows.sortWithinPartitions("sha", "page_id", "url")

    def put(batches):
        files, base = fs.FileSystem.from_uri(folder)
        part, number, out = TaskContext.get().partitionId(), 0, None
        done = []
        for batch in batches:
            for page_id, u, payload, sha, first, again in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    out = _Output(files, base, f"part-{part:06d}-{number:04d}")
                    number += 1
                digest = base64.b32encode(sha).decode()
                out.add(record(page_id, u, payload, digest, first, again, date), page_id, u, digest, date)
                if out.size >= archive_bytes or len(out.lines) >= ARCHIVE_RECORDS:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["archive", "bytes", "records"])

    return rows.mapInArrow(put, "archive string, bytes long, records long")


class Archive:
    """A ZIP file, read by ranges."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members: dict[str, tuple[int, int]] = {}
        self.packed: list[str] = []
        for name, where in self._directory():
            if where is None:
                self.packed.append(name)
            else:
                self.members[name] = where

    def read(self, offset: int, n: int) -> bytes:
        return bytes(self.file.read_at(n, offset))

    def _directory(self) -> Iterator[tuple[str, tuple[int, int] | None]]:
        """(name, (local header's offset, size)) of the stored members, and (name, None) of others."""
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        locator = tail_at + end - 20
        if locator >= 0 and (found := self.read(locator, 20))[:4] == b"PK\x06\x07":
            (at,) = struct.unpack("<Q", found[8:16])
            record64 = self.read(at, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, start = struct.unpack("<QQQ", record64[32:56])
        entries, at = self.read(start, length), 0
        for _ in range(count):
            if entries[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", entries[at + 8 : at + 12])
            packed, plain = struct.unpack("<II", entries[at + 20 : at + 28])
            n, m, k = struct.unpack("<HHH", entries[at + 28 : at + 34])
            (local,) = struct.unpack("<I", entries[at + 42 : at + 46])
            name = entries[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = entries[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                kind, size = struct.unpack("<HH", extra[:4])
                if kind == 1:  # those of the three that are all ones, in this order
                    wide = list(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + size :]
            yield name, (local, packed) if method == 0 and not flags & 1 else None
            at += 46 + n + m + k

    def data_at(self, name: str) -> int:
        """Where a member's bytes begin."""
        local, _ = self.members[name]
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n, m = struct.unpack("<HH", head[26:30])
        return local + 30 + n + m

    def lines(self, name: str, block: int = 1 << 20) -> Iterator[bytes]:
        """Lines of a stored member, gzipped or not."""
        at, left, rest = self.data_at(name), self.members[name][1], b""
        plain = zlib.decompressobj(31) if name.endswith(".gz") else None
        while left:
            data = self.read(at, min(block, left))
            at, left = at + len(data), left - len(data)
            if plain is not None:
                out = plain.decompress(data)
                while plain.eof and plain.unused_data:  # the next of several in a row
                    data, plain = plain.unused_data, zlib.decompressobj(31)
                    out += plain.decompress(data)
                if plain.eof:
                    plain = zlib.decompressobj(31)
                data = out
            *whole, rest = (rest + data).split(b"\n")
            yield from whole
        if rest:
            yield rest

    def ranges(self) -> Iterator[tuple[int, int]]:
        """(offset in the file, length) of every record, from the indexes or else by scanning."""
        if unread := [m for m in self.packed if _DATA.search(m)]:
            raise ValueError(f"members aren't stored as they are and can't be read by ranges: {', '.join(unread)}")
        data = [m for m in self.members if _DATA.search(m)]
        indexes = [m for m in self.members if _INDEX.search(m)]
        begins = {m.rpartition("/")[2]: self.data_at(m) for m in data} if indexes else {}
        named = {self._member(line, data) for m in indexes for line in self.lines(m) if b"{" in line}
        if not data or named != {m.rpartition("/")[2] for m in data}:
            for name in data:
                yield from self._scan(name)
            return
        for m in indexes:
            for line in self.lines(m):
                if b"{" in line:
                    entry = json.loads(line[line.index(b"{") :])
                    yield begins[self._member(line, data)] + int(entry["offset"]), int(entry["length"])

    def _member(self, line: bytes, data: list[str]) -> str | None:
        """File name of the member of records that an index line points into; one without a name, or without a range, serves if there is but one member."""
        entry = json.loads(line[line.index(b"{") :])
        if "offset" not in entry or "length" not in entry:
            return None
        name = entry.get("filename")
        return name.rpartition("/")[2] if name else data[0].rpartition("/")[2] if len(data) == 1 else None

    def _scan(self, name: str) -> Iterator[tuple[int, int]]:
        at = self.data_at(name)
        end = at + self.members[name][1]
        while at < end:
            if self.read(at, 2) == b"\x1f\x8b":
                plain, to = zlib.decompressobj(31), at
                while not plain.eof and to < end:
                    chunk = self.read(to, min(1 << 16, end - to))
                    to += len(chunk)
                    plain.decompress(chunk)
                if not plain.eof:
                    raise ValueError(f"a gzipped record of {name} is cut off")
                length = to - len(plain.unused_data) - at
            else:
                head, size = b"", 1 << 12
                while b"\r\n\r\n" not in head and len(head) < end - at:
                    head, size = self.read(at, min(size, end - at)), size * 4
                length = head.index(b"\r\n\r\n") + 8 + int(_fields(head)["content-length"])
            yield at, length
            at += length


_DATA, _INDEX = re.compile(r"\.warc(\.gz)?$"), re.compile(r"\.cdxj?(\.gz)?$")


def _fields(head: bytes) -> dict[str, str]:
    lines = head[: head.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if ":" in line)}


class _Files:
    """A task's open files."""

    def __init__(self, folder_uri: str):
        self.files, _ = fs.FileSystem.from_uri(folder_uri)
        self.open: dict[str, pa.NativeFile] = {}

    def __call__(self, path: str):
        if path not in self.open:
            while len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = self.files.open_input_file(path)
        return self.open[path]


def parse(data: bytes) -> dict:
    """Fields of one record, gzipped or not; a payload with a SHA-1 digest is checked against it.

    Records without HTTP headers have their block as payload; those without a
    digest have a null one.
    """
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompressobj(31).decompress(data)
    warc = _fields(data)
    body = data.index(b"\r\n\r\n") + 4
    block = data[body : body + int(warc["content-length"])]
    kind, digest = warc["warc-type"], warc.get("warc-payload-digest")
    http = warc.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block
    payload = None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4 :] if http else block
    if payload is not None and digest and digest.startswith("sha1:") and base32_sha1(payload) != digest.removeprefix("sha1:"):
        raise ValueError(f"payload of {warc.get('warc-record-id')} doesn't have its digest")
    number = lambda fields, name: int(fields[name]) if fields.get(name, "").isdecimal() else None
    told = _fields(block) if http and payload is None else {}
    return {
        "page_id": int(warc["page-id"]) if "page-id" in warc else None,
        "url": warc.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": len(payload) if payload is not None else number(told, "content-length"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
        "refers_to": int(warc["refers-to-page-id"]) if "refers-to-page-id" in warc else None,
        "payload": payload,
    }


def read(archives: DataFrame, folder: str, payloads: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All records of the archives named in column ``archive``, as ``RECORDS``; payloads are null for revisits or if not asked for."""
    ensure_importable(archives.sparkSession)

    def locate(batches):
        files = _Files(folder)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                file = files(path)
                found = []
                for where in Archive(file, file.size()).ranges():
                    found.append(where)
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *map(pa.array, zip(*found))], ["archive", "offset", "length"])
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *map(pa.array, zip(*found))], ["archive", "offset", "length"])

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def table(rows: list[dict], where: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
        columns += [pa.array(x, t) for x, t in zip(zip(*where), (pa.string(), pa.int64(), pa.int64()))]
        columns.append(pa.array([r["payload"] if payloads else None for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, [*schema.names, "archive", "offset", "length", "payload"])

    def fetch(batches):
        files = _Files(folder)
        for batch in batches:
            rows, where, held = [], [], 0
            for path, offset, length in zip(*(batch.column(n).to_pylist() for n in ("archive", "offset", "length"))):
                rows.append(parse(bytes(files(path).read_at(length, offset))))
                where.append((path, offset, length))
                held += len(rows[-1]["payload"] or b"") + 500
                if not payloads:
                    rows[-1]["payload"], held = None, len(rows) * 500
                if held >= HELD_BYTES:
                    yield table(rows, where)
                    rows, where, held = [], [], 0
            if rows:
                yield table(rows, where)

    spots = archives.select("archive").repartition("archive").mapInArrow(locate, "archive string, offset long, length long")
    blocks = spots.repartition("archive", F.floor(F.col("offset") / block_bytes)).sortWithinPartitions("archive", "offset")
    return blocks.mapInArrow(fetch, RECORDS)
