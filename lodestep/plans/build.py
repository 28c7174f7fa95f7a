"""The build: dump files of a wiki to a stored graph, and answers from it."""

from __future__ import annotations

import contextlib
import logging
import threading
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TookTooLong

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import session
from ..functions.names import KINDS, Metadata, format_dump, parse_dump
from ..operators import clean, search
from ..sources import dump, store
from ..streaming import watch

log = logging.getLogger(__name__)
#: Seconds a search may take.
LIMIT = 10.0


def build_graph(page: DataFrame, redirect: DataFrame, linktarget: DataFrame, pagelinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(redirects, links) from the four relations; ambiguous keys are errors."""
    clean.require_unique(page, ["namespace", "title"], "page_id", "page")
    resolved = clean.resolve_redirects(redirect, page)
    clean.require_unique(resolved, ["source"], "target", "redirect")
    redirects = clean.compress_redirects(resolved)
    targets = clean.resolve_linktargets(linktarget, page)
    clean.require_unique(targets, ["linktarget_id"], "page_id", "linktarget")
    return redirects, clean.links(pagelinks, targets, redirects)


def latest_date(spark: SparkSession, dumps: str, language_code: str) -> str:
    """The newest date of which all four dump files of a language are there."""
    dates: dict[str, set[str]] = {}
    for name, _ in session.children(spark, dumps):
        parsed = parse_dump(name)
        if parsed and parsed[0].language_code == language_code and parsed[1] in KINDS:
            dates.setdefault(parsed[0].date_code, set()).add(parsed[1])
    whole = [d for d, kinds in dates.items() if len(kinds) == len(KINDS)]
    if not whole:
        raise FileNotFoundError(f"no complete dump of {language_code} in {dumps}")
    return max(whole)


def build(
    spark: SparkSession,
    languages: Sequence[str] = ("en",),
    date: str = "latest",
    databases: str = "databases",
    dumps: str = "dumps",
    cleanup: bool = True,
    force: bool = False,
    partitions: int | None = None,
) -> list[Metadata]:
    """Build a database for each language from the dump files in ``dumps``.

    An existing database is kept unless ``force``.  If the folder holds the
    checksum list of the dump, the files are checked against it first.  With
    ``cleanup``, other dates of the language are deleted at the end.
    """
    done = []
    for language in languages:
        metadata = Metadata(language, latest_date(spark, dumps, language) if date == "latest" else date)
        final, draft = store.path_of(databases, metadata), store.draft_of(databases, metadata)
        if store.published(spark, final) and not force:
            log.info("%s exists", metadata.name)
            done.append(metadata)
            continue
        session.delete(spark, draft)
        sums = f"{dumps}/{language}wiki-{metadata.date_code}-sha1sums.txt"
        if session.exists(spark, sums):
            dump.check_files(spark, {f"{dumps}/{row.file_name}": row.sha1 for row in dump.checksums(spark, sums).collect()})  # four rows
        tables = {kind: dump.scan(spark, f"{dumps}/{format_dump(metadata, kind)}", kind, partitions) for kind in KINDS}
        page = tables["page"].persist()
        clean.require_rows(page, "page")
        redirects, links = build_graph(page, tables["redirect"], tables["linktarget"], tables["pagelinks"])
        store.write_redirects(redirects, draft, partitions)
        clean.require_rows(spark.read.parquet(f"{draft}/redirects"), "redirect")
        store.write_links(links, draft, partitions)
        clean.require_rows(spark.read.parquet(f"{draft}/links"), "pagelinks")
        page.unpersist()
        store.publish(spark, databases, metadata, replace=force)
        if cleanup:
            store.clean_up(spark, databases, metadata)
            store.clean_up(spark, dumps, metadata, dumps=True)
        done.append(metadata)
    return done


class Server:
    """Answers to the public interface's questions, over a folder of databases."""

    def __init__(self, spark: SparkSession, databases: str):
        self.spark, self.catalog = spark, store.Catalog(spark, databases).refresh()
        self._steps: dict[str, tuple[store.Database, search.Steps]] = {}
        self._users: dict[search.Steps, int] = {}
        self._lock = threading.RLock()

    def refresh(self) -> None:
        """List the folder anew; what is held of databases that went or were replaced is given back."""
        with self._lock:
            self.catalog.refresh()
            self._give_back()

    def _give_back(self) -> None:
        """Forget the steps of databases that aren't in the catalog; those in use go when their last search ends."""
        with self._lock:
            held = {d.metadata.name: d for d in self.catalog.databases.values()}
            for name, (database, steps) in list(self._steps.items()):
                if held.get(name) is not database:
                    del self._steps[name]
                    if not self._users.get(steps):
                        steps.unpersist()

    @contextlib.contextmanager
    def _used(self, database: store.Database) -> Iterator[search.Steps]:
        """The steps of a database for one search."""
        with self._lock:
            steps = self.steps(database)
            self._users[steps] = self._users.get(steps, 0) + 1
        try:
            yield steps
        finally:
            with self._lock:
                self._users[steps] -= 1
                if not self._users[steps]:
                    del self._users[steps]
                    if not any(s is steps for _, s in self._steps.values()):
                        steps.unpersist()

    def _leased(self, language_code: str, date_code: str, held: contextlib.ExitStack) -> store.Database:
        """The database with a lease on its generation; one that was replaced meanwhile is opened anew."""
        for _ in range(3):
            database = self.catalog.get(language_code, date_code)
            try:
                return held.enter_context(store.lease(database))
            except store.GenerationGone:
                self.refresh()
        raise KeyError((language_code, date_code))

    def watch(self, checkpoint: str, seconds: int = 5) -> StreamingQuery:
        """Keep up with the folder until the returned stream is stopped."""
        return watch.watch(self.catalog, checkpoint, lambda found: self._give_back(), seconds)

    def steps(self, database: store.Database) -> search.Steps:
        """The links both ways, once a database; few nodes are looked up in its files."""
        name = database.metadata.name
        with self._lock:
            if name not in self._steps or self._steps[name][0] is not database:
                self._steps[name] = database, search.Steps(database.links, database.near)
            return self._steps[name][1]

    def list_databases(self) -> str:
        return self.catalog.list_json()

    def shortest_paths(self, language_code: str, date_code: str, source: int, target: int, limit: float = LIMIT) -> str:
        """The response as JSON; KeyError for an unknown database.

        Beyond ``limit`` seconds TimeoutError is raised at once: running jobs are
        cancelled and the search stops before its next round.  Files of the
        search are deleted when it ends.  A search holds a lease on its
        generation, so that a rebuild meanwhile changes nothing for it.
        """
        held = contextlib.ExitStack()
        database = self._leased(language_code, date_code, held)
        group, late = f"paths-{language_code}-{source}-{target}-{uuid.uuid4().hex}", threading.Event()

        def answer() -> str:
            with held, self._used(database) as steps:
                self.spark.sparkContext.setJobGroup(group, group, True)
                pairs = self.spark.createDataFrame([(0, source, target)], "pair_id long, source_in long, target_in long")
                with session.cuts(self.spark):
                    found = search.shortest_paths(database.links, database.redirects, pairs, steps=steps, stop=late.is_set)
                    return search.to_json(search.records(found, language_code, date_code)).first().json

        pool = ThreadPoolExecutor(1)
        future = pool.submit(inheritable_thread_target(self.spark)(answer))
        try:
            return future.result(limit)
        except TookTooLong:
            late.set()
            self.spark.sparkContext.cancelJobGroup(group)
            raise TimeoutError(group) from None
        finally:
            pool.shutdown(wait=False)
