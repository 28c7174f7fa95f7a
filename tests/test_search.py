"""Shortest paths against a plain search, and the hand-made graph."""

import json
import random
from collections import deque

import pytest

from lodestep.operators import paths, search
from lodestep.session import cut

HAND = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (8, 1)]


def plain(edges, s, t):
    """(length, count, links) by a breadth-first search that counts ways."""
    if s == t:
        return 0, 1, set()
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    depth, ways, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        a = queue.popleft()
        for b in out.get(a, ()):
            if b not in depth:
                depth[b], ways[b] = depth[a] + 1, 0
                queue.append(b)
            if depth[b] == depth[a] + 1:
                ways[b] += ways[a]
    if t not in depth:
        return 0, 0, set()
    links, level = set(), {t}
    while level:
        step = {(a, b) for a, b in edges if b in level and a in depth and depth[a] + 1 == depth[b]}
        links |= step
        level = {a for a, _ in step}
    return depth[t], ways[t], links


def run(spark, edges, pairs, redirects=(), **options):
    graph = spark.createDataFrame(edges, "source long, target long")
    moved = spark.createDataFrame(list(redirects), "source long, target long")
    asked = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "pair_id long, source_in long, target_in long")
    return search.shortest_paths(graph, moved, asked, **options)


def results(found):
    links = {}
    for r in found.links.collect():
        links.setdefault(r.pair_id, set()).add((r.source, r.target))
    return {r.pair_id: (r.length, r["count"], links.get(r.pair_id, set())) for r in found.summary.collect()}


def test_hand_graph(spark):
    found = run(spark, HAND, [(1, 7), (9, 7), (7, 1), (5, 5), (404, 404)], [(9, 1)])
    got = results(found)
    assert [got[i][:2] for i in range(5)] == [(4, 4), (4, 4), (0, 0), (0, 1), (0, 1)]
    assert [len(got[i][2]) for i in range(5)] == [8, 8, 0, 0, 0]
    one = found.summary.where("pair_id = 1").first()
    assert (one.source, one.source_is_redirect, one.target_is_redirect) == (1, True, False)
    first = [tuple(r.path) for r in paths.enumerate_paths(found, 3).where("pair_id = 0").orderBy("rank").collect()]
    assert first == [(1, 2, 4, 5, 7), (1, 2, 4, 6, 7), (1, 3, 4, 5, 7)]
    record = json.loads(search.to_json(search.records(found, "en", "20240101")).where("pair_id = 0").first().json)
    assert record["links"]["4"] == [5, 6] and record["count"] == 4 and record["sourceIsRedirect"] is False


@pytest.mark.parametrize("force", [None, "F", "B"])
def test_random_graph(spark, force):
    r = random.Random(3)
    edges = sorted({(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(70)) if a != b})
    pairs = [(r.randrange(32), r.randrange(32)) for _ in range(12)]
    got = results(run(spark, edges, pairs, force=force))
    assert got == {i: plain(edges, s, t) for i, (s, t) in enumerate(pairs)}


def test_levels_beyond_the_broadcast_and_long_searches(spark, monkeypatch):
    """Levels that are shuffled, and more levels than the state holds apart, give the same."""
    edges = [(i, i + 1) for i in range(12)] + [(0, 20), (20, 2), (5, 21), (21, 7)]
    asked = [(0, 12), (12, 0), (3, 9)]
    wanted = {i: plain(edges, s, t) for i, (s, t) in enumerate(asked)}
    monkeypatch.setattr(search, "COMPACT", 2)
    for rows in (0, search.BROADCAST_ROWS):
        monkeypatch.setattr(search, "BROADCAST_ROWS", rows)
        assert results(run(spark, edges, asked)) == wanted


def test_paths_go_by_text(spark):
    found = run(spark, [(1, 9), (1, 10), (9, 2), (10, 2)], [(1, 2)])
    assert [r.path for r in paths.enumerate_paths(found, 1).collect()] == [[1, 10, 2]]
    assert paths.enumerate_paths(found, None).count() == 2


@pytest.mark.parametrize("near", [0, 6, 25, 10**6])
def test_a_search_that_grows_goes_on_far(spark, monkeypatch, near):
    """Whatever the driver may hold, answers are the same: from the start, from some level, or for the links only."""
    monkeypatch.setattr(search, "NEAR", near)
    r = random.Random(5)
    edges = sorted({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(110)) if a != b})
    pairs = [(r.randrange(42), r.randrange(42)) for _ in range(4)]
    assert results(run(spark, edges, pairs)) == {i: plain(edges, s, t) for i, (s, t) in enumerate(pairs)}
    depths = {n: plain(edges, edges[0][0], n)[0] for n in {x for e in edges for x in e} if plain(edges, edges[0][0], n)[1]}
    assert {x.node: x.depth for x in search.levels(spark.createDataFrame(edges, "source long, target long"), edges[0][0]).collect()} == depths


def test_more_pairs_than_the_driver_takes_and_pairs_without_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "NEAR_PAIRS", 2)
    asked = [(1, 7), (9, 7), (7, 1), (5, 5)]
    assert [results(run(spark, HAND, asked, [(9, 1)]))[i][:2] for i in range(4)] == [(4, 4), (4, 4), (0, 0), (0, 1)]


def test_few_nodes_are_looked_up(spark, monkeypatch):
    """The lookup is asked for levels of few nodes, and all steps are never kept."""
    graph = spark.createDataFrame(HAND, "source long, target long")
    asked = []

    def lookup(forward, back):
        asked.append((forward, back))
        steps = [("F", a, b) for a, b in HAND if a in forward] + [("B", b, a) for a, b in HAND if b in back]
        return spark.createDataFrame(steps, "dir string, a long, b long")

    steps = search.Steps(graph, lookup)
    pairs = spark.createDataFrame([(0, 1, 7)], "pair_id long, source_in long, target_in long")
    none = spark.createDataFrame([], "source long, target long")
    found = results(search.shortest_paths(graph, none, pairs, steps=steps))
    assert found == {0: plain(HAND, 1, 7)} and len(asked) == 5 and steps._frame is None
    monkeypatch.setattr(search, "LOOKUP", 0)
    asked.clear()
    assert results(search.shortest_paths(graph, none, pairs, steps=steps)) == found
    assert not asked and steps._frame is not None
    steps.unpersist()


def test_counts_beyond_64_bits_are_an_error(spark):
    edges = [(2 * i, x) for i in range(64) for x in (1000 + i, 2000 + i)] + [(x, 2 * i + 2) for i in range(64) for x in (1000 + i, 2000 + i)]
    with pytest.raises(OverflowError):
        run(spark, edges, [(0, 128)])
    assert results(run(spark, edges, [(0, 40)]))[0][:2] == (40, 2**20)


def test_a_large_level_is_shuffled_to_the_steps(spark):
    """Steps that are kept by their beginning stay where they are, whatever the level before."""
    steps = search.Steps(spark.createDataFrame(HAND, "source long, target long"))
    nodes = spark.createDataFrame([(0, "F", 1), (0, "B", 7)], "pair_id long, dir string, node long").hint("merge")
    found = search._step(nodes, steps.placed, nodes["dir"])
    assert sorted((r.dir, r.before, r.node) for r in found.collect()) == [("B", 7, 5), ("B", 7, 6), ("F", 1, 2), ("F", 1, 3)]
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "SortMergeJoin" in plan and plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning(a") == 0
    steps.unpersist()


def test_rounds_have_no_growing_estimate(spark):
    """What a round writes doesn't multiply the estimated sizes of those before, which made planning slower each time."""
    rows = spark.range(10)
    for _ in range(6):
        rows = cut(rows.join(rows.withColumnRenamed("id", "other"), rows["id"] <= 3).select("id").distinct())
    assert rows.count() == 4 and len(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 30


def test_lists_of_a_hub_and_tasks_by_rows(spark, monkeypatch):
    """Ends of a hub are in several lists; there are as many tasks as cores for few steps, whatever the shuffle's default."""
    edges = [(0, i) for i in range(1, 30)] + [(i, 50) for i in range(1, 30)] + [(50, 51)]
    monkeypatch.setattr(search, "LIST", 4)
    steps = search.Steps(spark.createDataFrame(edges, "source long, target long"))
    lists = [(r.dir, r.a, r.ends) for r in steps.placed.collect()]
    assert max(len(e) for *_, e in lists) == 4 and sorted((a, b) for d, a, e in lists if d == "F" for b in e) == sorted(edges)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert search.Steps(steps.graph).placed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    monkeypatch.setattr(search, "NEAR", 0)
    for rows in (0, search.BROADCAST_ROWS):
        monkeypatch.setattr(search, "BROADCAST_ROWS", rows)
        asked = [(0, 51), (51, 0), (3, 50)]
        assert results(run(spark, edges, asked)) == {i: plain(edges, s, t) for i, (s, t) in enumerate(asked)}
    steps.unpersist()
