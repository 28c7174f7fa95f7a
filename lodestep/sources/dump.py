"""Dump files: row scan with statistics, checksum lists and checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from . import gzindex
from ..functions import names, patterns
from ..functions.text import ratio

#: Bytes of a gzip file from which it is read by many tasks.
SPLIT = 64 << 20
_COLUMNS = {
    "page": (("page_id", patterns.page_id), ("namespace", patterns.namespace), ("title", None)),
    "redirect": (("rd_from", patterns.page_id), ("rd_namespace", patterns.namespace), ("rd_title", None)),
    "linktarget": (("lt_id", patterns.linktarget_id), ("lt_namespace", patterns.namespace), ("lt_title", None)),
    "pagelinks": (("pl_from", patterns.page_id), ("pl_target_id", patterns.linktarget_id)),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of dump files, plain or gzip; the only line end is the newline."""
    return spark.read.option("lineSep", "\n").text(path)


def parse(dump_lines: DataFrame, relation: str) -> DataFrame:
    """Every row of a relation, typed, with ``malformed`` for those with a value out of range or bytes that aren't UTF-8.

    Titles stay escaped: all relations escape alike, so they are equal or not as they stand.
    """
    value = F.col("value")
    found = dump_lines.select(F.explode(patterns.rows(value, relation)).alias("row"), (~F.is_valid_utf8(value)).alias("broken"))
    out = []
    for raw, (name, cast) in zip(patterns.groups(F.col("row"), relation), _COLUMNS[relation]):
        out.append((cast(raw) if cast else F.when(~(F.col("broken") & F.contains(raw, F.lit("�"))), raw)).alias(name))
    typed = found.select(*out)
    bad = F.lit(False)
    for name in typed.columns:
        bad = bad | F.col(name).isNull()
    return typed.withColumn("malformed", bad)


def split_lines(spark: SparkSession, path: str, least: int = SPLIT) -> DataFrame:
    """``lines``, of a large gzip file by way of its points, so that many tasks read it."""
    fs, target = session.filesystem(spark, path)
    large = path.endswith(".gz") and fs.exists(target) and fs.getFileStatus(target).isFile() and fs.getFileStatus(target).getLen() >= least
    return gzindex.lines(spark, path) if large else lines(spark, path)


def scan(spark: SparkSession, path: str, relation: str, partitions: int | None = None) -> DataFrame:
    """The well-formed rows of a relation; a large gzip file is read by many tasks, and with ``partitions`` a small one's rows are spread."""
    out = parse(split_lines(spark, path), relation).where("not malformed").drop("malformed")
    return out.repartition(partitions) if partitions else out


def statistics(parsed: DataFrame, relation: str, reasons: DataFrame | None = None) -> DataFrame:
    """(relation, reason, n, share): rows attempted, malformed, skipped by reason, and stored.

    ``reasons`` has a column ``reason`` for each well-formed row, null if it is stored.
    """
    counts = parsed.groupBy(F.when(F.col("malformed"), "malformed").alias("reason")).agg(F.count("*").alias("n"))
    if reasons is None:
        counts = counts.withColumn("reason", F.coalesce("reason", F.lit("stored")))
    else:
        kept = reasons.groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))
        counts = counts.where("reason is not null").unionByName(kept)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"))
    every = counts.unionByName(total.select(F.lit("attempted").alias("reason"), F.col("attempted").alias("n")))
    return every.crossJoin(F.broadcast(total)).select(F.lit(relation).alias("relation"), "reason", "n", ratio(F.col("n"), F.col("attempted")).alias("share"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(kind, language_code, date_code, file_name, sha1) of the first file of each kind in a checksum list.

    Files of other names are passed over; a line without the separator and a missing kind are errors.
    """
    listed = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text")).where("trim(text) <> ''")
    parts = F.split("text", "  ", 2)
    named = listed.select("line", F.when(F.size(parts) != 2, F.raise_error(F.concat(F.lit("no separator in: "), F.col("text")))).otherwise(parts).alias("p"))
    files = named.select("line", F.col("p")[0].alias("sha1"), F.col("p")[1].alias("file_name"))
    files = files.select("line", "sha1", "file_name", *names.dump_parts(F.col("file_name"))).where(F.col("kind").isin(*names.KINDS))
    first = files.groupBy("kind").agg(F.min(F.struct("line", "language_code", "date_code", "file_name", "sha1")).alias("f")).select("kind", "f.language_code", "f.date_code", "f.file_name", "f.sha1")
    missing = set(names.KINDS) - {r.kind for r in first.select("kind").collect()}
    if missing:
        raise ValueError(f"no file of kind {', '.join(sorted(missing))} in {path}")
    return first


def sha1s(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """SHA-1 of files at paths that ``pyarrow.fs`` opens: a task a file, which reads it as a stream."""
    session.importable(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, uri in zip(*(c.to_pylist() for c in batch.columns)):
                total = hashlib.sha1()
                with gzindex.opened(uri) as file:
                    while data := file.read(gzindex.READ):
                        total.update(data)
                yield pa.RecordBatch.from_pydict({"path": [path], "sha1": [total.hexdigest()]})

    named = spark.createDataFrame([(p, gzindex.address(spark, p)) for p in paths], "path string, uri string")
    return {r.path: r.sha1 for r in named.repartitionByRange(len(paths), "path").mapInArrow(digest, "path string, sha1 string").collect()}


def file_sha1(spark: SparkSession, path: str) -> str:
    """SHA-1 of a file, streamed."""
    return sha1s(spark, [path])[path]


def check_files(spark: SparkSession, sha1: dict[str, str]) -> None:
    """Raise unless the files have the SHA-1s."""
    for path, found in sorted(sha1s(spark, sorted(sha1)).items()):
        if found != sha1[path]:
            raise ValueError(f"{path} has SHA-1 {found}, not {sha1[path]}")


def check_file(spark: SparkSession, path: str, sha1: str) -> None:
    """Raise unless the file at ``path`` has the SHA-1."""
    check_files(spark, {path: sha1})
