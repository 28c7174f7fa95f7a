"""Build from dump files, publish, catalog, answers, and the stream that watches."""

import gzip
import hashlib
import json
import shutil
import time
from pathlib import Path

import pytest

from lodestep.functions.names import Metadata, parse_database, parse_dump
from lodestep.plans import build
from lodestep.sources import dump, store
from lodestep.streaming import watch

PAGES = [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, r"It\'s"), (9, "R")]


def write_dumps(folder, date, sums=True):
    folder.mkdir(exist_ok=True)
    rows = {
        "page": [f"({i},0,'{t}',0,0,0.5,'20240101000000',NULL,1,1,'wikitext',NULL)" for i, t in PAGES],
        "redirect": ["(9,0,'A',NULL,NULL)"],
        "linktarget": [f"({100 + i},0,'{t}')" for i, t in PAGES],
        "pagelinks": ["(1,0,102)", "(1,0,103)", "(2,0,104)", "(3,0,104)", "(4,0,109)", "(4,0,104)", "(1,0,102)", "(4,0,777)"],
    }
    lines = []
    for kind, r in rows.items():
        path = folder / f"enwiki-{date}-{kind}.sql.gz"
        path.write_bytes(gzip.compress(f"-- a dump\nINSERT INTO `{kind}` VALUES {','.join(r)};\n".encode()))
        lines.append(f"{hashlib.sha1(path.read_bytes()).hexdigest()}  {path.name}")
    lines.append("0" * 40 + "  enwiki-x.txt")
    if sums:
        (folder / f"enwiki-{date}-sha1sums.txt").write_text("\n".join(lines) + "\n")


def until(holds, seconds=60):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.2)


def test_build_and_answers(spark, tmp_path):
    dumps, databases = tmp_path / "dumps", str(tmp_path / "databases")
    write_dumps(dumps, "20240101")
    assert build.build(spark, databases=databases, dumps=str(dumps)) == [Metadata("en", "20240101")]
    server = build.Server(spark, databases)
    assert json.loads(server.list_databases()) == [{"languageCode": "en", "dateCode": "20240101"}]
    found = json.loads(server.shortest_paths("en", "20240101", 9, 4, limit=120))
    assert (found["length"], found["count"], found["links"]) == (2, 2, {"1": [2, 3], "2": [4], "3": [4]})
    assert (found["source"], found["sourceIsRedirect"]) == (1, True)
    with pytest.raises(KeyError):
        server.shortest_paths("en", "20250101", 1, 2)

    database = server.catalog.get("en", "20240101")
    asked = spark.createDataFrame([(1,), (9,), (404,)], "page_id long")
    assert {r.page_id: r.target for r in database.redirect(asked).collect()} == {1: None, 9: 1, 404: None}
    assert {r.page_id: r.sources for r in database.incoming_links(asked).collect()} == {1: [4], 9: [], 404: []}
    assert {r.page_id: r.targets for r in database.outgoing_links(asked).collect()} == {1: [2, 3], 9: [], 404: []}

    seen = []
    stream = watch.watch(server.catalog, str(tmp_path / "checkpoint"), seen.append, seconds=None)
    stream.awaitTermination()
    assert seen == [[{"languageCode": "en", "dateCode": "20240101"}]]

    write_dumps(dumps, "20240201")
    build.build(spark, databases=databases, dumps=str(dumps))
    assert list(store.Catalog(spark, databases).refresh().list()) == [{"languageCode": "en", "dateCode": "20240201"}]
    assert not [p for p in dumps.iterdir() if "20240101" in p.name and p.name.endswith(".gz")]


def test_wrong_checksum_and_missing_kind(spark, tmp_path):
    write_dumps(tmp_path / "d", "20240101")
    path = tmp_path / "d" / "enwiki-20240101-page.sql.gz"
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(ValueError, match="SHA-1"):
        build.build(spark, databases=str(tmp_path / "db"), dumps=str(tmp_path / "d"))
    (tmp_path / "sums").write_text("abc  enwiki-20240101-page.sql.gz\n")
    with pytest.raises(ValueError, match="no file of kind"):
        dump.checksums(spark, str(tmp_path / "sums"))
    (tmp_path / "sums").write_text("no separator\n")
    with pytest.raises(Exception, match="separator"):
        dump.checksums(spark, str(tmp_path / "sums"))


def test_malformed_rows_are_counted(spark, tmp_path):
    path = tmp_path / "page.sql"
    row = b"(%s,0,'%s',0,1,0.5,'1',NULL,1,1,NULL,NULL)"
    path.write_bytes(b"-- x\nVALUES " + b",".join([row % (b"1", b"ok"), row % (b"4294967296", b"big"), row % (b"3", b"\xff")]) + b";\n")
    parsed = dump.parse(dump.lines(spark, str(path)), "page")
    assert {(r.reason, r.n) for r in dump.statistics(parsed, "page").collect()} == {("stored", 1), ("malformed", 2), ("attempted", 3)}


def test_names():
    assert parse_database("wp-en-20240101") == Metadata("en", "20240101")
    assert parse_database("wp-zh_min-20240101") is None and parse_database("wp-en-x") is None
    assert parse_dump("enwiki-20240101-page.sql.gz") == (Metadata("en", "20240101"), "page")
    dates = [Metadata("en", d).dates_apart(Metadata("en", "20240102")) for d in ("20240101", "20240102", "20240110")]
    assert dates == [-1, 0, 1] and Metadata("de", "2").dates_apart(Metadata("en", "1")) is None


def test_files_are_hashed_as_streams(spark, tmp_path):
    for i, data in enumerate((b"", b"abc", bytes(range(256)) * 20_000)):
        (tmp_path / str(i)).write_bytes(data)
        assert dump.file_sha1(spark, f"file://{tmp_path}/{i}") == hashlib.sha1(data).hexdigest()


def test_leftover_draft_force_and_reload(spark, tmp_path):
    write_dumps(tmp_path / "d", "20240101")
    folders = {"databases": str(tmp_path / "db"), "dumps": str(tmp_path / "d")}
    left = Path(store.draft_of(folders["databases"], Metadata("en", "20240101")), "links")
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"half a file")
    build.build(spark, **folders)
    assert not left.exists()
    server = build.Server(spark, folders["databases"])
    first = server.catalog.get("en", "20240101")
    steps = server.steps(first)
    assert server.steps(first) is steps
    build.build(spark, force=True, **folders)
    server.refresh()
    again = server.catalog.get("en", "20240101")
    assert again is not first and not server._steps and sorted(again.links.collect()) == sorted(spark.read.schema(again.links.schema).parquet(f"{folders['databases']}/wp-en-20240101/links").select(*again.links.columns).collect())
    stream = server.watch(str(tmp_path / "clock"), seconds=1)
    try:
        build.build(spark, force=True, **folders)
        until(lambda: server.catalog.databases["en"] is not again)
        shutil.rmtree(tmp_path / "db" / "wp-en-20240101")
        until(lambda: server.catalog.databases == {})
    finally:
        stream.stop()
    with pytest.raises(KeyError):
        server.shortest_paths("en", "20240101", 1, 2)


def test_a_late_search_stops_and_leaves_no_files(spark, tmp_path, monkeypatch):
    import glob

    from lodestep import session
    from lodestep.operators import search

    write_dumps(tmp_path / "d", "20240101")
    build.build(spark, databases=str(tmp_path / "db"), dumps=str(tmp_path / "d"))
    server = build.Server(spark, str(tmp_path / "db"))
    session.shared_dir(spark)
    files = lambda: set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/rdd-*"))
    session.cut(spark.range(3))
    before = files()
    assert before
    server.shortest_paths("en", "20240101", 1, 2)
    assert files() == before
    rounds, levels = [], search._levels
    monkeypatch.setattr(search, "_levels", lambda *a: (rounds.append(1), time.sleep(3), levels(*a))[-1])
    began = time.time()
    with pytest.raises(TimeoutError):
        server.shortest_paths("en", "20240101", 1, 2, limit=0.5)
    assert time.time() - began < 2.5
    for _ in range(60):
        if rounds and files() == before:
            break
        time.sleep(0.2)
    assert files() == before
