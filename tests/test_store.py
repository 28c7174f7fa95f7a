"""Lookups by files, parts of hubs, generations and their leases."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from lodestep import session
from lodestep.functions.names import Metadata
from lodestep.operators import search
from lodestep.plans import build
from lodestep.sources import store
from test_store_build import write_dumps

NAME = Metadata("en", "20240101")


def make(spark, folder, links, redirects=((9_999_999, 0),), partitions=None, replace=False):
    draft = store.draft_of(str(folder), NAME)
    store.write_redirects(spark.createDataFrame(list(redirects), "source long, target long"), draft)
    store.write_links(links, draft, partitions)
    return store.open_database(spark, store.publish(spark, str(folder), NAME, replace))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "page_id long")


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Links i to i + 1 and i to i + 2, in many files."""
    n = spark.range(4000)
    links = n.select(F.col("id").alias("source"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("target"))
    return make(spark, tmp_path_factory.mktemp("chain"), links, partitions=16)


def test_one_page_reads_one_file(spark, chain, monkeypatch):
    assert len(glob.glob(f"{chain.path}/outgoing/gen={chain.generation}/*.parquet")) >= 12
    for table, key in (("outgoing", "source"), ("incoming", "target")):
        found = chain.rows(table, [777])
        assert len(found.inputFiles()) == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo({key},777)" in plan or f"In({key}, [777])" in plan
    assert chain.outgoing_links(ids(spark, 777)).first().targets == [778, 779]
    assert chain.incoming_links(ids(spark, 777)).first().sources == [775, 776]
    assert chain.files("outgoing", [10**9]) == [] and chain.outgoing_links(ids(spark, 10**9)).first().targets == []
    whole = chain.files("outgoing", list(range(0, 4000, 100)))
    assert len(whole) >= 12
    # a manifest that the driver doesn't keep gives the same files
    monkeypatch.setattr(store, "MANIFEST_ROWS", 3)
    again = store.open_database(spark, chain.path)
    assert again.files("outgoing", list(range(0, 4000, 100))) == whole and again.files("incoming", [5]) == chain.files("incoming", [5])
    assert again.files("incoming", []) == []


@pytest.mark.parametrize("most", [0, 1000])
def test_lookups_by_files_and_by_the_table_agree(spark, chain, monkeypatch, most):
    monkeypatch.setattr(store, "LOOKUP", most)
    asked = ids(spark, 0, 5, 5, None, 3999, 4001, -1)
    assert sorted((r.page_id, r.sources) for r in chain.incoming_links(asked).collect() if r.page_id is not None) == [(-1, []), (0, []), (5, [3, 4]), (5, [3, 4]), (3999, [3997, 3998]), (4001, [3999])]
    assert {r.page_id: r.target for r in chain.redirect(ids(spark, 9_999_999, 1)).collect()} == {9_999_999: 0, 1: None}


def test_manifest_holds_each_file_once(spark, chain):
    rows = chain.manifest.collect()
    there = {os.path.basename(f) for t in ("redirects", "links", "incoming", "outgoing") for f in glob.glob(f"{chain.path}/{t}/gen=*/*.parquet")}
    assert len(rows) == len({(r.table, r.file) for r in rows}) and {r.file for r in rows} <= there
    assert sum(r.rows for r in rows if r.table == "links") == 8000


def test_a_hub_is_no_row_and_no_task(spark, tmp_path):
    """A page with a million links: parts are bounded, files share them, and lists are whole."""
    n = 1_000_000
    hub = spark.range(n).select((F.col("id") + 10).alias("source"), F.lit(1).cast("long").alias("target"))
    database = make(spark, tmp_path, hub.unionByName(hub.where("source < 30").select(F.col("target").alias("source"), F.col("source").alias("target"))), partitions=8)
    sizes = [r.n for r in database.incoming_parts(ids(spark, 1)).select(F.size("sources").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) <= store.PART and len(sizes) >= n // store.PART
    files = [r for r in database.manifest.where("table = 'incoming'").collect() if r.low <= 1 <= r.high]
    assert len(files) >= 6 and max(r.rows for r in files) < len(sizes) / 2
    assert database.incoming_links(ids(spark, 1)).select(F.size("sources").alias("n"), (F.array_sort("sources") == F.col("sources")).alias("sorted"), F.size(F.array_distinct("sources")).alias("d")).first() == (n, True, n)
    asked = spark.createDataFrame([(0, 29, 1), (1, 12, 13), (2, 500_000, 11)], "pair_id long, source_in long, target_in long")
    found = search.shortest_paths(database.links, database.redirects, asked, steps=search.Steps(database.links, database.near))
    assert {r.pair_id: (r.length, r["count"]) for r in found.summary.collect()} == {0: (1, 1), 1: (2, 1), 2: (2, 1)}


def test_generations_and_leases(spark, tmp_path):
    old = make(spark, tmp_path, spark.createDataFrame([(1, 2)], "source long, target long"))
    path = old.path
    with pytest.raises(store.DatabaseExists):
        make(spark, tmp_path, spark.createDataFrame([(1, 3)], "source long, target long"))
    session.delete(spark, store.draft_of(str(tmp_path), NAME))
    with store.lease(old):
        new = make(spark, tmp_path, spark.createDataFrame([(1, 3)], "source long, target long"), replace=True)
        assert old.outgoing_links(ids(spark, 1)).first().targets == [2]  # held
        assert new.outgoing_links(ids(spark, 1)).first().targets == [3]
        with pytest.raises(store.GenerationGone), store.lease(old):
            pass
        assert os.path.isdir(f"{path}/links/gen={old.generation}")
    assert not os.path.isdir(f"{path}/links/gen={old.generation}") and store.generations(spark, path) == [new.generation]
    # a lease of a process that died runs out
    dead = f"{path}/leases/{new.generation}/1-dead"
    session.touch(spark, dead)
    third = make(spark, tmp_path, spark.createDataFrame([(1, 4)], "source long, target long"), replace=True)
    assert not os.path.isdir(f"{path}/links/gen={new.generation}") and not os.path.exists(dead)
    # a database that is cleaned up is closed at once and goes with its last lease
    with store.lease(third):
        assert store.clean_up(spark, str(tmp_path), Metadata("en", "20250101")) == [NAME.name]
        assert not store.published(spark, path) and third.outgoing_links(ids(spark, 1)).first().targets == [4]
        with pytest.raises(FileNotFoundError):
            store.open_database(spark, path)
    assert not os.path.exists(path)


def test_a_rebuild_during_a_search_changes_nothing(spark, tmp_path, monkeypatch):
    """The search reads its generation to the end, and at no moment is there no database."""
    write_dumps(tmp_path / "d", "20240101")
    folders = {"databases": str(tmp_path / "db"), "dumps": str(tmp_path / "d")}
    build.build(spark, **folders)
    server = build.Server(spark, folders["databases"])
    wanted = server.shortest_paths("en", "20240101", 9, 4, limit=120)
    first = server.catalog.get("en", "20240101")
    started, rebuilt, run = threading.Event(), threading.Event(), search._Near.run

    def slow(*a):
        started.set()
        assert rebuilt.wait(120)
        return run(*a)

    monkeypatch.setattr(search._Near, "run", slow)
    answers, always, done = [], [], threading.Event()
    searching = threading.Thread(target=lambda: answers.append(server.shortest_paths("en", "20240101", 9, 4, limit=240)))
    looking = threading.Thread(target=lambda: [always.append(store.published(spark, first.path)) for _ in iter(done.is_set, True)])
    searching.start()
    looking.start()
    assert started.wait(120)
    build.build(spark, force=True, **folders)
    server.refresh()
    assert os.path.isdir(f"{first.path}/links/gen={first.generation}") and server.catalog.get("en", "20240101") is not first
    rebuilt.set()
    searching.join(240)
    done.set()
    looking.join()
    assert answers == [wanted] and len(always) > 10 and all(always)
    assert not os.path.isdir(f"{first.path}/links/gen={first.generation}") and not server._users
