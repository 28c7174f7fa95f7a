"""Links in batches: any order, sent again, cut off, merged at any time."""

import itertools
import random

import pytest

from lodestep import session
from lodestep.streaming import ingest


def frame(spark, links):
    return spark.createDataFrame(links, "source long, target long")


@pytest.fixture(scope="module")
def batches():
    r = random.Random(4)
    return [[(r.randrange(9), r.randrange(200)) for _ in range(60)] for _ in range(3)]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_any_order_and_sent_again(spark, tmp_path, batches, order):
    folder = ingest.LinkFolder(spark, str(tmp_path / "links"), buckets=3)
    assert folder.links().count() == 0 and not folder.compact()
    for n, i in enumerate(order):
        assert folder.append(frame(spark, batches[i]), i)
        assert not folder.append(frame(spark, [(77, 77)]), i)  # the batch is there
        if n == 1:
            assert folder.compact() and folder.deltas() == []
            assert not folder.append(frame(spark, [(77, 77)]), order[0])  # and known in the base
    wanted = sorted({x for b in batches for x in b})
    assert sorted(map(tuple, folder.links().collect())) == wanted
    assert sorted(map(tuple, folder.links("incoming").collect())) == wanted
    assert folder.deltas() == [order[2]]
    lists = {}
    for row in folder.lists("incoming").collect():
        lists.setdefault(row.target, []).extend(row.sources)
    assert lists == {t: sorted(s for s, _ in g) for t, g in itertools.groupby(sorted(wanted, key=lambda x: (x[1], x[0])), key=lambda x: x[1])}
    assert sorted(map(tuple, folder.of("outgoing", [3, 8, 500]).collect())) == [x for x in wanted if x[0] in (3, 8)]
    folder.compact()
    folder.sweep()
    again = ingest.LinkFolder(spark, str(tmp_path / "links"), buckets=3)
    assert sorted(map(tuple, again.links().collect())) == wanted and again.deltas() == []
    assert len(list((tmp_path / "links" / "base").iterdir())) == 1 and not list((tmp_path / "links" / "delta").iterdir())


def test_what_was_cut_off_is_written_anew(spark, tmp_path):
    folder = ingest.LinkFolder(spark, str(tmp_path), buckets=2)
    folder._write(frame(spark, [(5, 6)]), f"{folder.path}/delta/0")  # no mark: the writer died
    assert folder.links().count() == 0
    assert folder.append(frame(spark, [(1, 2), (1, 2), (None, 3)]), 0)
    # a compaction that died before its pointer changes nothing
    folder._write(frame(spark, [(9, 9)]), f"{folder.path}/base/half")
    assert list(map(tuple, folder.links().collect())) == [(1, 2)]
    # one that died after it, before marks went, either
    assert folder.compact()
    session.touch(spark, f"{folder.path}/done/0")
    assert folder.deltas() == [] and not folder.compact() and list(map(tuple, folder.links().collect())) == [(1, 2)]


def test_a_stream_of_links(spark, tmp_path, batches):
    """Files that come one by one are batches; a stream that starts again goes on where it was."""
    folder, source = ingest.LinkFolder(spark, str(tmp_path / "links"), buckets=2), tmp_path / "in"
    source.mkdir()

    def run():
        stream = spark.readStream.schema(ingest.LINKS).option("maxFilesPerTrigger", 1).csv(str(source))
        folder.sink(stream, str(tmp_path / "checkpoint"), deltas=2, once=True).awaitTermination()

    for i, batch in enumerate(batches):
        (source / f"{i}.csv").write_text("".join(f"{a},{b}\n" for a, b in batch))
        if i:
            run()
    run()
    assert sorted(map(tuple, folder.links().collect())) == sorted({x for b in batches for x in b})
    assert folder.deltas() == [2] and folder._base()[1] == [(0, 1)]


def test_runs_of_batches():
    assert ingest._joined([(5, 5), (0, 2), (3, 3), (7, 9), (8, 8)]) == [(0, 3), (5, 5), (7, 9)]
    assert ingest._within(2, [(0, 3)]) and not ingest._within(4, [(0, 3), (5, 6)])


def test_a_batch_is_shuffled_once_each_way(spark, tmp_path):
    """Repeated links go within the ranges in which links are written."""
    folder, links = ingest.LinkFolder(spark, str(tmp_path), buckets=2), [(i % 50, i % 7) for i in range(2000)]
    folder._write(frame(spark, links), f"{tmp_path}/x")
    for way in ingest.WAYS:
        assert sorted((r.source, r.target) for r in spark.read.parquet(f"{tmp_path}/x/{way}").collect()) == sorted(set(links))
        dealt = folder._dealt(frame(spark, links), way)
        dealt.collect()
        plan = dealt._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
