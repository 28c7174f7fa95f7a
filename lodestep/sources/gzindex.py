"""Lines of one gzip file, read by many tasks.

A gzip file can be entered only where the state of the decompressor is known.  One
streaming pass notes such points at the borders of compressed blocks, some
``SPAN`` bytes of text apart: the offset and bit in the file, the offset in the
text, and the 32 KB of text before it, to which what follows may refer.  The
points are kept as a table beside the file.  Then each stretch between two points
is a row, and tasks inflate stretches on their own.

A stretch has the lines that begin in it: the last of them is read on into the
next stretch, and the first one's beginning is known from the byte before the
point.  So each line is found once, wherever the points are.

Files of several members, as parallel compressors write them, are one text.  A
damaged or cut file is an error in the pass.  Paths are those that ``pyarrow.fs``
opens.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Bytes of text between two points, of a read, and of text that is inflated at once.
SPAN, READ, ROOM = 32 << 20, 1 << 20, 1 << 18
#: Bytes of lines that a task holds before it hands them on.
HELD = 4 << 20
WINDOW = 1 << 15
#: A point: its place in file and text, the text before it, whether a line begins there, and where the next point is.
POINTS = "file string, size long, begin long, bits int, start long, stop long, before binary, fresh boolean"

# Numbers of the decompression library's interface.
_END, _OK, _STUCK, _AT_BLOCK, _GZIP, _RAW = 1, 0, -5, 5, 31, -15


class _Stream(ctypes.Structure):
    """The library's view of a stream."""

    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p),
        ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


def _library():
    found = ctypes.CDLL(ctypes.util.find_library("z") or "libz.so.1")
    found.zlibVersion.restype = ctypes.c_char_p
    return found


class Inflater:
    """Text of a gzip file from its start or from a point, block by block if asked."""

    def __init__(self, file, begin: int = 0, bits: int = 0, before: bytes = b"", start: int = 0):
        self.zlib, self.file, self.at = _library(), file, begin - (bits > 0)
        self.start = start  # of the text that is still to come
        self.whole = file.size()
        self.stream, self.room = _Stream(), ctypes.create_string_buffer(ROOM)
        self.raw = bool(begin)
        self._check(self.zlib.inflateInit2_(ctypes.byref(self.stream), _RAW if self.raw else _GZIP, self.zlib.zlibVersion(), ctypes.sizeof(_Stream)))
        self.data = b""
        self.ended = False
        if bits:
            self._check(self.zlib.inflatePrime(ctypes.byref(self.stream), bits, self._byte() >> (8 - bits)))
        if before:
            self._check(self.zlib.inflateSetDictionary(ctypes.byref(self.stream), before, len(before)))

    def close(self) -> None:
        self.zlib.inflateEnd(ctypes.byref(self.stream))

    def _check(self, code: int) -> None:
        if code not in (_OK, _END, _STUCK):
            raise ValueError(f"not a whole gzip file, near byte {self.at}: {(self.stream.msg or b'code ' + str(code).encode()).decode()}")

    def _fill(self) -> bool:
        if not self.stream.avail_in:
            self.data = bytes(self.file.read_at(min(READ, self.whole - self.at), self.at)) if self.at < self.whole else b""
            self.at += len(self.data)
            self.buffer = ctypes.create_string_buffer(self.data, len(self.data))
            self.stream.next_in, self.stream.avail_in = ctypes.cast(self.buffer, ctypes.c_void_p), len(self.data)
        return self.stream.avail_in > 0

    def _byte(self) -> int:
        """The next byte of the file."""
        if not self._fill():
            raise ValueError("the gzip file is cut off")
        value = self.data[len(self.data) - self.stream.avail_in]
        self.stream.next_in, self.stream.avail_in = self.stream.next_in + 1, self.stream.avail_in - 1
        return value

    def window(self) -> bytes:
        """The text before this place to which what follows may refer."""
        out, n = ctypes.create_string_buffer(WINDOW), ctypes.c_uint(0)
        self._check(self.zlib.inflateGetDictionary(ctypes.byref(self.stream), out, ctypes.byref(n)))
        return out.raw[: n.value]

    def point(self) -> tuple[int, int] | None:
        """(offset, bits of the byte before it) if the next block begins here."""
        kind = self.stream.data_type
        if self.ended or not kind & 128 or kind & 64:
            return None
        return self.at - self.stream.avail_in, kind & 7

    def _next_member(self) -> bool:
        """Go on with the file's next member, if there is one; zeros may pad the end."""
        if self.raw:
            for _ in range(8):  # a checksum and a length, which the other form reads itself
                self._byte()
        while self._fill() and not self.data[len(self.data) - self.stream.avail_in]:
            self._byte()
        if not self._fill():
            return False
        left, self.raw = (self.stream.next_in, self.stream.avail_in), False
        self.close()
        self.stream = _Stream()
        self._check(self.zlib.inflateInit2_(ctypes.byref(self.stream), _GZIP, self.zlib.zlibVersion(), ctypes.sizeof(_Stream)))
        self.stream.next_in, self.stream.avail_in = left
        return True

    def read(self, by_block: bool = False) -> bytes:
        """Some text; empty at the end, and maybe at the border of a block."""
        while not self.ended:
            more = self._fill()
            self.stream.next_out, self.stream.avail_out = ctypes.cast(self.room, ctypes.c_void_p), ROOM
            code = self.zlib.inflate(ctypes.byref(self.stream), _AT_BLOCK if by_block else 0)
            self._check(code)
            out = self.room.raw[: ROOM - self.stream.avail_out]
            self.start += len(out)
            if code == _END:
                self.ended = not self._next_member()
            elif not more and not out:
                raise ValueError("the gzip file is cut off")
            if out or by_block:
                return out
        return b""


def points(file, name: str, span: int) -> Iterator[dict]:
    """The points of one file, and the stretches that begin there."""
    text = Inflater(file)
    here = {"file": name, "size": file.size(), "begin": 0, "bits": 0, "start": 0, "before": b"", "fresh": True}
    last = b"\n"
    try:
        while not text.ended:
            last = text.read(by_block=True)[-1:] or last
            at = text.point()
            if at and text.start - here["start"] >= span:
                yield here | {"stop": text.start}
                here |= {"begin": at[0], "bits": at[1], "start": text.start, "before": zlib.compress(text.window()), "fresh": last == b"\n"}
        yield here | {"stop": text.start}
    finally:
        text.close()


def stretch_lines(file, begin: int, bits: int, start: int, stop: int, before: bytes, fresh: bool) -> Iterator[bytes]:
    """The lines that begin from ``start`` to before ``stop``, without their ends; an empty line at the end is none."""
    text = Inflater(file, begin, bits, zlib.decompress(before) if before else b"", start)
    at, parts = start, []  # of the line that is being read, and what is there of it
    skipping = not fresh
    try:
        while at < stop or skipping:
            data = text.read()
            if not data:
                break
            low = 0
            while (end := data.find(b"\n", low)) >= 0:
                if not skipping:
                    yield b"".join([*parts, data[low:end]])
                parts, skipping, low = [], False, end + 1
                at = text.start - len(data) + low
                if at >= stop:
                    return
            if not skipping:
                parts.append(data[low:])
            elif text.start >= stop:
                return  # one line holds the whole stretch
        if not skipping and at < stop and any(parts):
            yield b"".join(parts)
    finally:
        text.close()


def address(spark: SparkSession, path: str) -> str:
    """A path as ``opened`` takes it in any task."""
    files, target = session.filesystem(spark, path)
    uri = files.makeQualified(target).toString()
    return uri if not uri.startswith("file:") else "/" + uri.removeprefix("file:").lstrip("/")


def opened(uri: str) -> pa.NativeFile:
    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem().open_input_file(uri)
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def created(uri: str) -> pa.NativeFile:
    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem().open_output_stream(uri, compression=None)
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_output_stream(path, compression=None)


def joined(spark: SparkSession, folder: str, path: str) -> str:
    """``path``, one gzip file whose members are the gzip files of a folder, in order of their names.

    Their bytes are copied as they are, by a task that holds ``READ`` of them.
    """
    session.importable(spark)
    files, target = session.filesystem(spark, path)
    files.mkdirs(target.getParent())
    parts, uri = [address(spark, f"{folder}/{name}") for name, _ in session.children(spark, folder) if name.endswith(".gz")], address(spark, path)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column(0).to_pylist():
                with created(uri) as out:
                    for name in names:
                        with opened(name) as file:
                            while data := file.read(READ):
                                out.write(data)
                    yield pa.RecordBatch.from_pydict({"size": [out.tell()]})

    spark.createDataFrame([(parts,)], "files array<string>").mapInArrow(copy, "size long").collect()
    return path


def index(spark: SparkSession, path: str, span: int = SPAN) -> str:
    """The path of the table of points of a gzip file, which is made if it isn't there or belongs to a file of another length."""
    session.importable(spark)
    where = f"{path}.points"
    files, target = session.filesystem(spark, path)
    size = files.getFileStatus(target).getLen()
    if session.exists(spark, f"{where}/_SUCCESS") and spark.read.schema(POINTS).parquet(where).select("size").first() == (size,):
        return where
    uri = address(spark, path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    for p in points(file, name, span):
                        yield pa.RecordBatch.from_pydict({k: [p[k]] for k in p}, pa.schema([("file", pa.string()), ("size", pa.int64()), ("begin", pa.int64()), ("bits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("before", pa.binary()), ("fresh", pa.bool_())]))

    spark.createDataFrame([(uri,)], "file string").mapInArrow(find, POINTS).write.mode("overwrite").parquet(where)
    return where


def lines(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(value): the lines of a gzip file, each stretch inflated by a task of its own."""
    stretches = spark.read.schema(POINTS).parquet(index(spark, path, span)).where("start < stop")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                held, size = [], 0
                with opened(p["file"]) as file:
                    for line in stretch_lines(file, p["begin"], p["bits"], p["start"], p["stop"], p["before"], p["fresh"]):
                        held.append(line)
                        size += len(line)
                        if size >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    # by place and not by hash, so that tasks get stretches alike
    dealt = stretches.repartitionByRange(max(1, min(stretches.count(), 100_000)), "start")
    return dealt.mapInArrow(inflate, "value binary").select(F.col("value").cast("string").alias("value"))
