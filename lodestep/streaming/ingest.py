"""Links that come in batches: a folder of link tables that grows, with lists both ways.

Each batch is written once, as a delta of its id: for both directions a table of
its distinct links in buckets of the key, sorted.  Reading merges the base and the
deltas: links are sets, so batches may overlap, come in any order and be sent
again.  A batch counts when its mark is there, which is made last; a batch that
is sent again after that is passed over, and one that was cut off before it is
written anew.

Compaction merges base and deltas into a new base and names in it the batches
that it holds.  Then a pointer of a higher number is made; the one of the highest
number counts.  So a compaction that is cut off changes nothing, and a batch that
is sent again after its compaction is known by the base's list.  Tasks write
ranges of (bucket, key, other end), so that neither a bucket nor a hub is one
task's.

Paths are any that Spark reads.  One process writes to a folder at a time, any
number read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import session
from ..sources import store

#: Buckets of a fresh folder, and deltas after which a sink compacts.
BUCKETS, DELTAS = 64, 16
LINKS = "source long, target long"
WAYS = {"outgoing": ("source", "target"), "incoming": ("target", "source")}


def _within(batch: int, runs: list[tuple[int, int]]) -> bool:
    return any(a <= batch <= b for a, b in runs)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of ids in order, neighbours put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a - 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(eq=False)
class LinkFolder:
    """A growing set of links."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    _replaced: list[str] = field(default_factory=list)

    def _base(self) -> tuple[str | None, list[tuple[int, int]]]:
        """The newest base, and the batches in it as runs of ids."""
        named = [n for n, _ in session.children(self.spark, f"{self.path}/current")]
        if not named:
            return None, []
        base = named[-1].partition("-")[2]
        return base, [tuple(r) for r in self.spark.read.schema("first long, last long").parquet(f"{self.path}/base/{base}/batches").collect()]

    def deltas(self) -> list[int]:
        """Batches that are written and in no base, in order."""
        _, folded = self._base()
        done = sorted(int(n) for n, _ in session.children(self.spark, f"{self.path}/done"))
        return [i for i in done if not _within(i, folded)]

    def _dealt(self, links: DataFrame, way: str) -> DataFrame:
        """Links with their bucket, each once, sorted: a task takes a range of (bucket, key, value), so neither a bucket nor a hub is one task's."""
        key, value = WAYS[way]
        bucketed = links.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
        # equal rows are in one range, so repeated ones go without a shuffle of their own, which finding the ranges would do once more
        return bucketed.repartitionByRange("bucket", key, value).distinct().sortWithinPartitions("bucket", key, value)

    def _write(self, links: DataFrame, path: str) -> None:
        """Links by bucket of either end."""
        for way in WAYS:
            self._dealt(links, way).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{way}")

    def append(self, batch: DataFrame, batch_id: int) -> bool:
        """Write a batch of (source, target) as a delta; False if this batch is there already."""
        _, folded = self._base()
        if _within(batch_id, folded) or session.exists(self.spark, f"{self.path}/done/{batch_id}"):
            return False
        self._write(batch.select("source", "target").where("source is not null and target is not null"), f"{self.path}/delta/{batch_id}")
        session.touch(self.spark, f"{self.path}/done/{batch_id}")
        return True

    def _read(self, way: str) -> DataFrame:
        base, _ = self._base()
        paths = [f"{self.path}/base/{base}/{way}"] * (base is not None) + [f"{self.path}/delta/{i}/{way}" for i in self.deltas()]
        schema = f"{LINKS}, bucket int"
        out = self.spark.createDataFrame([], schema)
        for path in paths:
            out = out.unionByName(self.spark.read.schema(schema).parquet(path))
        return out

    def links(self, way: str = "outgoing") -> DataFrame:
        """(source, target) of all batches, each once."""
        return self._read(way).select("source", "target").distinct()

    def lists(self, way: str) -> DataFrame:
        """(key, part, values): the lists of one direction, in parts of bounded length."""
        key, value = WAYS[way]
        return store.in_parts(self.links(way), key, value)

    def of(self, way: str, ids: list[int]) -> DataFrame:
        """(source, target) of the links of few keys; only their buckets are read."""
        key, _ = WAYS[way]
        asked = self.spark.createDataFrame([(i,) for i in ids], "id long").select(F.pmod(F.xxhash64("id"), F.lit(self.buckets)).alias("b"))
        buckets = sorted({r.b for r in asked.collect()})
        return self._read(way).where(F.col("bucket").isin(buckets) & F.col(key).isin(ids)).select("source", "target").distinct()

    def compact(self) -> bool:
        """Merge all deltas into a new base; False if there are none."""
        base, folded = self._base()
        new = self.deltas()
        if not new:
            return False
        name = uuid.uuid4().hex
        where = f"{self.path}/base/{name}"
        self._write(self._read("outgoing").select("source", "target"), where)
        runs = _joined([*folded, *((i, i) for i in new)])
        self.spark.createDataFrame(runs, "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{where}/batches")
        numbers = [int(n.partition("-")[0]) for n, _ in session.children(self.spark, f"{self.path}/current")]
        session.touch(self.spark, f"{self.path}/current/{max(numbers, default=0) + 1:012d}-{name}")
        for i in new:
            session.delete(self.spark, f"{self.path}/done/{i}")
        # a reader that began before may still have these open
        self._replaced += [*([f"{self.path}/base/{base}"] if base else []), *(f"{self.path}/delta/{i}" for i in new)]
        return True

    def sweep(self) -> None:
        """Delete the files that this writer's compactions replaced; for when no reader has them open."""
        while self._replaced:
            session.delete(self.spark, self._replaced.pop())

    def sink(self, links: DataFrame, checkpoint: str, deltas: int = DELTAS, once: bool = False) -> StreamingQuery:
        """Write a stream of (source, target); every ``deltas`` batches are compacted."""

        def put(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            if len(self.deltas()) >= deltas:
                self.compact()

        writer = links.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
