"""Stored graphs: one folder per language and date with a Parquet table for each of redirects, links, incoming and outgoing.

Tables are sorted by their key, and a manifest tells the range of keys of each
file, so that a lookup of few pages opens only the files that can hold them.
Lists of neighbours are cut into parts of at most ``PART`` ids: no row and no
task holds all links of a hub.

A graph is built under ``.tmp``.  Publishing moves its tables into the database's
folder as a new generation (``links/gen=...``) and then makes a pointer file,
``current/<number>-<generation>``; the pointer of the highest number counts, so
there is no moment without a database.  Who reads holds a lease on its
generation; an older generation is deleted when its last lease ends.  A lease
that isn't given back, as its process died, runs out.

Paths are any that Spark reads.
"""

from __future__ import annotations

import contextlib
import json
import logging
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions.names import Metadata, parse_database, parse_dump
from ..schemas import KEYS, MANIFEST, TABLES

log = logging.getLogger(__name__)

#: Ids in a part of a list, as a power of two.
PART_BITS = 12
PART = 1 << PART_BITS
#: Pages that are looked up by files; more are joined with the table.
LOOKUP = 1000
#: Rows of a manifest that the driver keeps; a longer one is asked by a job each time.
MANIFEST_ROWS = 100_000
#: Seconds after which a lease runs out.
LEASE_S = 3600


class DatabaseExists(FileExistsError):
    pass


class GenerationGone(FileNotFoundError):
    """The generation was replaced, and its files may be gone."""


def path_of(folder: str, metadata: Metadata) -> str:
    return f"{folder.rstrip('/')}/{metadata.name}"


def draft_of(folder: str, metadata: Metadata) -> str:
    return f"{folder.rstrip('/')}/.tmp/{metadata.name}"


def _spread(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Ranges of the keys, each sorted."""
    return (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def write_redirects(redirects: DataFrame, path: str, partitions: int | None = None) -> None:
    _spread(redirects.select("source", "target"), partitions, "source").write.mode("errorifexists").parquet(f"{path}/redirects")


def in_parts(links: DataFrame, key: str, value: str, partitions: int | None = None) -> DataFrame:
    """(key, part, values): sorted lists of at most ``PART`` ids.

    Links are sorted by both columns, so that a hub's are spread over ranges;
    each stretch of ``PART`` rows of a range gives a part to each key in it.
    """
    ordered = _spread(links.select(key, value), partitions, key, value)
    stretch = ordered.withColumn("_stretch", F.shiftright(F.monotonically_increasing_id(), PART_BITS))
    lists = stretch.groupBy(key, "_stretch").agg(F.array_sort(F.collect_list(value)).alias("_list"))
    return lists.select(key, F.col("_list")[0].alias("part"), F.col("_list").alias(f"{value}s"))


def write_links(links: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the links, and from what was written the lists by target and by source."""
    spark = links.sparkSession
    _spread(links.select("source", "target").distinct(), partitions, "source", "target").write.mode("errorifexists").parquet(f"{path}/links")
    stored = spark.read.schema(TABLES["links"]).parquet(f"{path}/links")
    for table, key, value in (("incoming", "target", "source"), ("outgoing", "source", "target")):
        _spread(in_parts(stored, key, value, partitions), partitions, key, "part").write.mode("errorifexists").parquet(f"{path}/{table}")


def write_manifest(spark: SparkSession, path: str) -> None:
    """Write the range of keys of each file of the tables; only the keys are read."""
    out = None
    for table, key in KEYS.items():
        rows = spark.read.schema(TABLES[table]).parquet(f"{path}/{table}").select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("key"))
        files = rows.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))
        files = files.select(F.lit(table).alias("table"), "file", "low", "high", "rows")
        out = files if out is None else out.unionByName(files)
    _spread(out, None, "table", "low").write.mode("errorifexists").parquet(f"{path}/manifest")


def generations(spark: SparkSession, path: str) -> list[str]:
    """Generations that a database's pointers name, the newest last."""
    return [name.partition("-")[2] for name, _ in session.children(spark, f"{path}/current")]


def published(spark: SparkSession, path: str) -> bool:
    return bool(generations(spark, path))


def _leased(spark: SparkSession, path: str, generation: str) -> bool:
    """Whether a lease that hasn't run out holds the generation; those that have are deleted."""
    held = False
    for name, _ in session.children(spark, f"{path}/leases/{generation}"):
        if int(name.partition("-")[0]) < time.time():
            session.delete(spark, f"{path}/leases/{generation}/{name}")
        else:
            held = True
    return held


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Delete the generations that are replaced and not held, and a database without any; what went is returned.

    The pointer goes first, then leases are asked for: who takes a lease looks
    for the pointer afterwards, so either the lease is seen here or its taker
    sees that the generation is gone.
    """
    pointers = [name for name, _ in session.children(spark, f"{path}/current")]
    newest = pointers[-1].partition("-")[2] if pointers else None
    for name in pointers[:-1]:
        session.delete(spark, f"{path}/current/{name}")
    gone, held = [], False
    there = {name.partition("=")[2] for table in (*TABLES, "manifest") for name, _ in session.children(spark, f"{path}/{table}") if name.startswith("gen=")}
    for generation in sorted(there - {newest}):
        if _leased(spark, path, generation):
            held = True
            continue
        for table in (*TABLES, "manifest"):
            session.delete(spark, f"{path}/{table}/gen={generation}")
        session.delete(spark, f"{path}/leases/{generation}")
        gone.append(generation)
    if newest is None and not held:
        session.delete(spark, path)
    return gone


def _take(spark: SparkSession, path: str, generation: str) -> str:
    lease = f"{path}/leases/{generation}/{int(time.time()) + LEASE_S}-{uuid.uuid4().hex}"
    session.touch(spark, lease)
    return lease


def _give_back(spark: SparkSession, path: str, lease: str) -> None:
    session.delete(spark, lease)
    sweep(spark, path)


@contextlib.contextmanager
def lease(database: Database) -> Iterator[Database]:
    """Hold a database's files until the end; GenerationGone if they are replaced already."""
    spark, path = database.spark, database.path
    taken = _take(spark, path, database.generation)
    try:
        if database.generation not in generations(spark, path):
            raise GenerationGone(f"{path}, generation {database.generation}")
        yield database
    finally:
        _give_back(spark, path, taken)


def publish(spark: SparkSession, folder: str, metadata: Metadata, replace: bool = False) -> str:
    """Make a complete draft the newest generation of its database; an existing database is an error unless it is replaced."""
    draft, final = draft_of(folder, metadata), path_of(folder, metadata)
    if published(spark, final) and not replace:
        raise DatabaseExists(final)
    if not session.exists(spark, f"{draft}/manifest"):
        write_manifest(spark, draft)
    generation = uuid.uuid4().hex
    taken = _take(spark, final, generation)  # so that nobody sweeps what has no pointer yet
    for table in (*TABLES, "manifest"):
        session.rename(spark, f"{draft}/{table}", f"{final}/{table}/gen={generation}")
    numbers = [int(name.partition("-")[0]) for name, _ in session.children(spark, f"{final}/current")]
    session.touch(spark, f"{final}/current/{max(numbers, default=0) + 1:012d}-{generation}")
    # the mark by which a watching stream learns of the database
    spark.createDataFrame([(metadata.name,)], "value string").coalesce(1).write.mode("append").text(f"{final}/complete")
    session.delete(spark, draft)
    _give_back(spark, final, taken)
    return final


@dataclass(eq=False)
class Database:
    """A generation of a stored graph that is open for reading."""

    metadata: Metadata
    spark: SparkSession
    path: str
    generation: str
    redirects: DataFrame
    links: DataFrame
    incoming: DataFrame
    outgoing: DataFrame
    manifest: DataFrame
    _ranges: dict[str, tuple[list[int], list[tuple[int, str]]]] | None = None

    def _kept_ranges(self) -> dict[str, tuple[list[int], list[tuple[int, str]]]] | None:
        """For each table the least keys of its files, in order, and their greatest keys and names; None for a long manifest."""
        if self._ranges is None:
            rows = self.manifest.orderBy("table", "low", "high").limit(MANIFEST_ROWS + 1).collect()
            if len(rows) > MANIFEST_ROWS:
                return None
            self._ranges = {t: ([r.low for r in rows if r.table == t], [(r.high, r.file) for r in rows if r.table == t]) for t in TABLES}
        return self._ranges

    def files(self, table: str, ids: list[int]) -> list[str]:
        """The files of a table that can hold keys."""
        ranges = self._kept_ranges()
        if ranges is None:
            fits = F.exists(F.lit(ids), lambda x: x.between(F.col("low"), F.col("high")))
            found = {r.file for r in self.manifest.where((F.col("table") == table) & fits).select("file").collect()} if ids else set()
        else:
            lows, files = ranges[table]
            found = set()
            for x in ids:
                i = bisect_right(lows, x) - 1
                # files are ranges of the sorted table: a key's neighbours may share it, so greatest keys fall with the least
                while i >= 0 and files[i][0] >= x:
                    found.add(files[i][1])
                    i -= 1
        return [f"{self.path}/{table}/gen={self.generation}/{name}" for name in sorted(found)]

    def rows(self, table: str, ids: list[int]) -> DataFrame:
        """The rows of a table with one of few keys: only files that can hold them are opened, and the keys are pushed down."""
        files, read = self.files(table, ids), self.spark.read.schema(TABLES[table])
        if not files:
            return self.spark.createDataFrame([], TABLES[table])
        return read.parquet(*files).where(F.col(KEYS[table]).isin(ids))

    def _of(self, table: str, pages: DataFrame) -> DataFrame:
        """The rows of a table for the pages."""
        ids = [r.page_id for r in pages.select("page_id").where("page_id is not null").distinct().limit(LOOKUP + 1).collect()]
        if len(ids) <= LOOKUP:
            return self.rows(table, ids)
        asked = pages.select(F.col("page_id").alias("_asked")).distinct()
        return getattr(self, table).join(asked, F.col(KEYS[table]) == F.col("_asked"), "left_semi")

    def _lists(self, table: str, values: str, pages: DataFrame) -> DataFrame:
        none = F.array().cast("array<bigint>")
        whole = self._of(table, pages).groupBy(F.col(KEYS[table]).alias("_key")).agg(F.array_sort(F.flatten(F.collect_list(values))).alias(values))
        return pages.select("page_id").join(whole, F.col("page_id") == F.col("_key"), "left").select("page_id", F.coalesce(values, none).alias(values))

    def redirect(self, pages: DataFrame) -> DataFrame:
        """(page_id, target) of the pages; target is null for a page that is no redirect."""
        found = self._of("redirects", pages)
        return pages.select("page_id").join(found, F.col("page_id") == F.col("source"), "left").select("page_id", "target")

    def incoming_links(self, pages: DataFrame) -> DataFrame:
        """(page_id, sources); an unknown page has none.  A hub's list is one row here; ``incoming_parts`` has it in parts."""
        return self._lists("incoming", "sources", pages)

    def outgoing_links(self, pages: DataFrame) -> DataFrame:
        """(page_id, targets); an unknown page has none."""
        return self._lists("outgoing", "targets", pages)

    def incoming_parts(self, pages: DataFrame) -> DataFrame:
        """(page_id, part, sources): rows of at most ``PART`` ids."""
        return self._of("incoming", pages).withColumnRenamed("target", "page_id")

    def outgoing_parts(self, pages: DataFrame) -> DataFrame:
        return self._of("outgoing", pages).withColumnRenamed("source", "page_id")

    def near(self, forward: list[int], back: list[int]) -> DataFrame:
        """(dir, a, b): the steps from few nodes, forwards from some and backwards from others."""
        f = self.rows("outgoing", forward).select(F.lit("F").alias("dir"), F.col("source").alias("a"), F.explode("targets").alias("b"))
        b = self.rows("incoming", back).select(F.lit("B").alias("dir"), F.col("target").alias("a"), F.explode("sources").alias("b"))
        return f.unionByName(b)


def open_database(spark: SparkSession, path: str) -> Database:
    """Open the newest generation of a database; its name must be one, and all its tables must be there."""
    path = path.rstrip("/")
    metadata = parse_database(path.rpartition("/")[2])
    if metadata is None:
        raise ValueError(f"{path} isn't named like a database")
    missing: list[str] = []
    for _ in range(3):  # a generation may be replaced and swept meanwhile
        found = generations(spark, path)
        if not found:
            raise FileNotFoundError(f"{path} isn't published")
        at = {t: f"{path}/{t}/gen={found[-1]}" for t in (*TABLES, "manifest")}
        missing = [t for t, where in at.items() if not session.exists(spark, where)]
        if not missing:
            tables = {t: spark.read.schema(s).parquet(at[t]) for t, s in (TABLES | {"manifest": MANIFEST}).items()}
            return Database(metadata, spark, path, found[-1], **tables)
    raise FileNotFoundError(f"{path} has no {', '.join(missing)}")


@dataclass
class Catalog:
    """The newest database of each language in a folder."""

    spark: SparkSession
    folder: str
    databases: dict[str, Database] = field(default_factory=dict)

    def refresh(self) -> Catalog:
        """List the folder anew; a database that can't be opened is passed over with a warning."""
        found: dict[str, Database] = {}
        for name, is_folder in session.children(self.spark, self.folder):
            metadata = parse_database(name)
            if metadata is None or not is_folder:
                continue
            held = found.get(metadata.language_code)
            if held and (metadata.dates_apart(held.metadata) or 0) <= 0:
                continue
            try:
                opened = open_database(self.spark, f"{self.folder.rstrip('/')}/{name}")
                kept = self.databases.get(metadata.language_code)
                # what is open already stays, with what is remembered of it
                found[metadata.language_code] = kept if kept and (kept.path, kept.generation) == (opened.path, opened.generation) else opened
            except (OSError, ValueError) as problem:
                log.warning("skipped %s: %s", name, problem)
        self.databases = dict(sorted(found.items()))
        return self

    def state(self) -> list[tuple[str, ...]]:
        """What is in the folder: each database with its newest generation."""
        folder = self.folder.rstrip("/")
        names = [n for n, is_folder in session.children(self.spark, folder) if is_folder and parse_database(n)]
        return [(n, *generations(self.spark, f"{folder}/{n}")[-1:]) for n in names]

    def list(self) -> list[dict[str, str]]:
        return [{"languageCode": d.metadata.language_code, "dateCode": d.metadata.date_code} for d in self.databases.values()]

    def list_json(self) -> str:
        return json.dumps(self.list())

    def get(self, language_code: str, date_code: str) -> Database:
        """The database, or KeyError if the catalog doesn't hold exactly it."""
        found = self.databases.get(language_code)
        if found is None or found.metadata.date_code != date_code:
            raise KeyError((language_code, date_code))
        return found


def newest(names: DataFrame) -> DataFrame:
    """(language_code, date_code) of the newest of each language among (language_code, date_code); dates compare as text."""
    return names.where("language_code is not null").groupBy("language_code").agg(F.max("date_code").alias("date_code"))


def outdated(names: DataFrame, keep: DataFrame) -> DataFrame:
    """Names of the same language and another date than those to keep."""
    kept = keep.select(F.col("language_code").alias("_l"), F.col("date_code").alias("_d"))
    return names.join(kept, (F.col("language_code") == F.col("_l")) & (F.col("date_code") != F.col("_d"))).drop("_l", "_d")


def clean_up(spark: SparkSession, folder: str, metadata: Metadata, dumps: bool = False) -> list[str]:
    """Delete databases, or dump files, of the same language and another date; their names are returned.

    A database that is held by a lease is closed to new readers and goes with its last lease.
    """
    gone = []
    for name, _ in session.children(spark, folder):
        parsed = (parse_dump(name.removesuffix(".points")) or (None,))[0] if dumps else parse_database(name)
        if parsed and parsed.language_code == metadata.language_code and parsed.date_code != metadata.date_code:
            path = f"{folder.rstrip('/')}/{name}"
            if dumps:
                session.delete(spark, path)
            else:
                session.delete(spark, f"{path}/current")
                sweep(spark, path)
            gone.append(name)
    return gone
