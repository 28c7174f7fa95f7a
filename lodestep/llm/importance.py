"""Resampling of documents by importance towards a target distribution.

A text's features are its runs of 1 to 3 words; each falls into one of
``BUCKETS`` by the CRC-32 of its bytes.  Documents are written once as packed
streams: a block holds the buckets of many documents as unsigned 16-bit
integers, with the offset at which each document begins.  For the corpus counts
each block is sorted and run-length encoded, and a task's runs are added up
before they leave it.  The gains of the buckets, a fixed number, are then
broadcast, gathered along the streams and summed between the offsets.

The CRC of a run isn't taken from its text: the CRC of two strings put together
is that of the first, moved over the second's length by tables of that length,
xor the second's.  So each word's CRC is taken once, and runs follow by array
operations.

Ranks come from a sorted table: rows are sorted by ranges, and a row's rank is
its place in its partition after the rows of the partitions before.

Null and empty texts and texts without words have no features, weight 0 and a
score; only documents of ``least`` words or more are drawn.  Repeated rows are
documents each; equal scores go by ascending id, null ids last.  Empty tables
give an empty one; an empty target has no features.  Texts are whole, however
long: one of more than ``PART`` features stands in several blocks.  Other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .session import Scratch, ensure_importable

BUCKETS, RUN = 10_000, 3
#: Features of a block of whole documents, and of one part of a longer document.
BLOCK, PART = 1 << 20, 1 << 24
#: Longest word whose CRC is moved by a table of its length; a longer one is moved on its own.
_TABLED = 64
# Fixed value: the polynomial of CRC-32, reflected.
_POLYNOMIAL = 0xEDB88320


def _moved(columns: list[int], x: int) -> int:
    """A linear map, given by the images of the 32 bits, of ``x``."""
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= columns[i]
        x >>= 1
        i += 1
    return out


@functools.cache
def _over(length: int) -> list[int]:
    """The map that moves a CRC over ``length`` bytes, by doubling."""
    if length == 0:
        return [1 << i for i in range(32)]
    if length == 1:
        step = [_POLYNOMIAL] + [1 << i for i in range(31)]  # one bit
        for _ in range(3):
            step = [_moved(step, x) for x in step]
        return step
    half = _over(length // 2)
    out = [_moved(half, x) for x in half]
    return [_moved(_over(1), x) for x in out] if length % 2 else out


@functools.cache
def _tables() -> np.ndarray:
    """[length][byte of the CRC][value]: what it becomes when moved over ``length`` bytes."""
    out = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    for n in range(_TABLED + 1):
        bits = np.array(_over(n), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[n, byte, 1 << bit : 2 << bit] = out[n, byte, : 1 << bit] ^ bits[8 * byte + bit]
    return out


def _join(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings put together, from those of both parts and the length of the second."""
    tables = _tables()
    n = np.minimum(length, _TABLED)
    out = second.copy()
    for byte in range(4):
        out ^= tables[n, byte, (first >> np.uint32(8 * byte)) & np.uint32(255)]
    for i in np.flatnonzero(length > _TABLED).tolist():
        out[i] = _moved(_over(int(length[i])), int(first[i])) ^ int(second[i])
    return out


_SPACE = zlib.crc32(b" ")


class Features:
    """The buckets of a text's runs of words, a piece at a time."""

    def __init__(self, run: int = RUN, buckets: int = BUCKETS):
        self.run, self.buckets = run, buckets
        self.tail = (np.empty(0, np.uint32), np.empty(0, np.int64))
        self.words = 0

    def add(self, part: list[bytes]) -> np.ndarray:
        """Buckets of the runs that end in ``part``, the text's next words."""
        crc = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
        size = np.fromiter(map(len, part), np.int64, len(part))
        old = len(self.tail[0])
        crc, size = np.concatenate([self.tail[0], crc]), np.concatenate([self.tail[1], size])
        out, runs = [crc[old:] % self.buckets], crc
        spaced = _join(np.full(len(crc), _SPACE, np.uint32), crc, size)  # of " word"
        for n in range(2, self.run + 1):
            runs = _join(runs[:-1], spaced[n - 1 :], size[n - 1 :] + 1) if len(runs) > 1 else runs[:0]
            out.append(runs[max(0, old - n + 1) :] % self.buckets)
        keep = self.run - 1
        self.tail = (crc[-keep:], size[-keep:])
        self.words += len(part)
        return np.concatenate(out).astype("<u2")


def _streams(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Blocks (ids, keys, words, starts, stream, whole); a key stands for a row and is the same in each part of a long text."""
    kind = df.schema[id_].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        names = ["ids", "keys", "words", "starts", "stream", "whole"]
        ids, keys, n, starts, parts, size = [], [], [], [], [], 0

        def block(id_type, ids, keys, n, starts, parts, whole) -> pa.RecordBatch:
            data = np.concatenate([np.empty(0, "<u2"), *parts]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), pa.array([keys], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([np.array(starts, "<i8").tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([whole])], names)

        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for id_, raw in zip(batch.column(0).to_pylist(), words.texts(batch.column(1))):
                own, found, held, counted, whole = Features(), [], 0, 0, True
                for part in words.pieces(raw):
                    found.append(own.add(part))
                    held += len(found[-1])
                    if held >= PART:
                        yield block(id_type, [id_], [row], [own.words - counted], [0], found, False)
                        found, held, counted, whole = [], 0, own.words, False
                if whole:
                    ids.append(id_)
                    keys.append(row)
                    n.append(own.words)
                    starts.append(size)
                    parts += found
                    size += held
                elif held:
                    yield block(id_type, [id_], [row], [own.words - counted], [0], found, False)
                row += 1
                if size >= BLOCK or len(ids) >= BLOCK >> 4:
                    yield block(id_type, ids, keys, n, starts, parts, True)
                    ids, keys, n, starts, parts, size = [], [], [], [], [], 0
        if ids:
            yield block(id_type, ids, keys, n, starts, parts, True)

    schema = f"ids array<{kind}>, keys array<long>, words array<long>, starts binary, stream binary, whole boolean"
    return df.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(write, schema)


def _counts(streams: DataFrame) -> np.ndarray:
    """How often each bucket stands in the streams; a row a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                run = np.sort(np.frombuffer(stream.as_py(), "<u2"))
                first = np.flatnonzero(np.diff(run.astype(np.int32), prepend=-1))
                total[run[first]] += np.diff(first, append=len(run))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = streams.select("stream").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1000 times the logarithm of its smoothed share of the target over that of the source."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, id_: object) -> int:
    """The fixed random part of a document's score; ids count as text, a null id as none."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(streams: DataFrame, gain: np.ndarray, kind: str) -> DataFrame:
    """(key, id, n_features, words, weight) of each row of a block."""
    sent = streams.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, n, starts, stream in zip(*(batch.column(c) for c in range(5))):
                at = np.frombuffer(starts.as_py(), "<i8")
                got = sent.value[np.frombuffer(stream.as_py(), "<u2")]
                size = np.diff(at, append=len(got))
                weight = np.zeros(len(at), np.int64)
                if len(got):  # reduceat has no empty sums
                    weight[size > 0] = np.add.reduceat(got, at[size > 0])
                yield pa.RecordBatch.from_arrays([keys.values, ids.values, pa.array(size), n.values, pa.array(weight)], ["key", "id", "n_features", "words", "weight"])

    return streams.select("ids", "keys", "words", "starts", "stream").mapInArrow(weigh, f"key long, id {kind}, n_features long, words long, weight long")


def _ranked(scored: DataFrame, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Add the rank of those that are drawn: ``share[0] / share[1]`` of the eligible, best score first."""
    ordered = scored.orderBy(F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_last())
    # both parts of the number are fixed when the sorted partition is written
    ordered = scratch.table(ordered.withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33).alias("part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("n"), F.count_if("eligible").alias("fit"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.floor(F.sum("fit").over(Window.partitionBy()) * share[0] / share[1]).alias("drawn"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = ordered.withColumn("part", part).join(F.broadcast(sizes), "part")
    return out.withColumn("rank", F.when(F.col("eligible") & (rank <= F.col("drawn")), rank))


def resample(docs: DataFrame, target: DataFrame, id_: str = "doc_id", text: str = "text", target_text: str = "text", share: tuple[int, int] = (5, 100), least: int = 20, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of ``docs``; rank is null for those that aren't drawn.

    The score is the weight and Gumbel noise, so that drawing the best scores is
    drawing without replacement in proportion to the importance.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark, "resample")
    kind = docs.schema[id_].dataType.simpleString()
    streams = scratch.table(_streams(docs, id_, text), "streams")
    wanted = _streams(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text")
    gain = gains(_counts(streams), _counts(wanted))
    whole = _weighed(streams.where("whole"), gain, kind).drop("key")
    # parts of long texts, a row for each
    parts = _weighed(streams.where("not whole"), gain, kind).groupBy("key").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_features", "words", "weight"))).drop("key")

    @F.pandas_udf("long")
    def random(s):
        return s.map(lambda x: noise(seed, x)).astype("int64")

    scored = whole.unionByName(parts).withColumn("score", F.col("weight") + random(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("eligible", F.col("words") >= least)
    out = _ranked(scored.drop("words"), share, scratch)
    scratch.drop("streams")
    return out.select(F.col("id").alias(id_), "n_features", "weight", "score", "rank")
