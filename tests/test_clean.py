"""Redirect chains and links."""

import random

import pytest

from lodestep.operators import clean
from lodestep.plans.fixtures import Fixture

LINE = {i: i + 1 for i in range(20, 29)}
RING = {i: 40 + (i - 39) % 5 for i in range(40, 45)}
CHAINS = [
    ({}, {}),
    ({8: 60}, {8: 60}),
    (LINE, dict.fromkeys(LINE, 29)),
    (RING, {}),
    (RING | {50: 42, 51: 50}, {}),
    (RING | LINE, dict.fromkeys(LINE, 29)),
    ({6: 6, 31: 6}, {}),
    (LINE | {70: 24, 71: 24, 72: 71}, dict.fromkeys([*LINE, 70, 71, 72], 29)),
]


def compressed(spark, edges):
    df = spark.createDataFrame(list(edges.items()), "source long, target long")
    return {r.source: r.target for r in clean.compress_redirects(df).collect()}


@pytest.mark.parametrize(("edges", "wanted"), CHAINS)
def test_chains(spark, edges, wanted):
    assert compressed(spark, edges) == wanted


def test_random_chains(spark):
    r = random.Random(5)
    edges = {i: r.randrange(40) for i in r.sample(range(40), 30)}

    def end(i):
        seen = set()
        while i in edges and i not in seen:
            seen.add(i)
            i = edges[i]
        return None if i in edges else i

    assert compressed(spark, edges) == {i: end(i) for i in edges if end(i) is not None}


def test_order_of_the_steps(spark):
    """A redirect to itself is dropped before chains are followed, so a redirect to that page stays."""
    page = spark.createDataFrame([(75, 0, "A"), (85, 0, "B")], "page_id long, namespace int, title string")
    redirect = spark.createDataFrame([(75, 0, "A"), (85, 0, "A"), (1, 0, "none"), (2, 9, "A")], "rd_from long, rd_namespace int, rd_title string")
    reasons = {r.source: r.reason for r in clean.redirect_reasons(redirect, page).collect()}
    assert reasons == {75: "self_redirect", 85: None, 1: "missing_target_title", 2: "missing_target_namespace"}
    assert [tuple(r) for r in clean.compress_redirects(clean.resolve_redirects(redirect, page)).collect()] == [(85, 75)]


def test_unique_keys(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B")], "page_id long, title string")
    clean.require_unique(rows, ["title"], "page_id", "page")
    with pytest.raises(ValueError):
        clean.require_unique(rows.unionByName(spark.createDataFrame([(3, "B")], "page_id long, title string")), ["title"], "page_id", "page")
    with pytest.raises(ValueError):
        clean.require_rows(rows.where("false"), "page")


@pytest.mark.parametrize("spaces", [10_000, 1])
def test_reasons_with_namespaces_broadcast_or_not(spark, spaces, monkeypatch):
    monkeypatch.setattr(clean, "SPACES", spaces)
    page = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 4, "a"), (4, None, "c")], "page_id long, namespace int, title string")
    rows = [(10, 0, "a"), (11, 4, "a"), (12, 4, "b"), (13, 9, "a"), (14, None, "c"), (15, 0, None)]
    found = clean.linktarget_reasons(spark.createDataFrame(rows, "lt_id long, lt_namespace int, lt_title string"), page)
    assert ("BroadcastHashJoin" in found.select("reason")._jdf.queryExecution().sparkPlan().toString()) or spaces == 1
    wanted = {10: (1, None), 11: (3, None), 12: (None, "missing_target_title"), 13: (None, "missing_target_namespace"), 14: (None, "missing_target_namespace"), 15: (None, "missing_target_title")}
    assert {r.linktarget_id: (r.page_id, r.reason) for r in found.collect()} == wanted


def test_tables_are_not_broadcast_for_their_small_files(spark, tmp_path):
    """Files of a few KB may hold many rows: pages and rows of the fixture are joined by a shuffle, only namespaces are broadcast."""
    spark.range(3000).selectExpr("id div 5 as l_orderkey", "cast(id % 5 as int) as l_linenumber", "id % 700 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(700).selectExpr("id as p_partkey", "concat('p ', id) as p_name", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    fx = Fixture(spark, str(tmp_path))
    assert fx.pagelinks.count() == 2400
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(fx.pagelinks) + plan(fx.redirect)
    stored = spark.read.parquet(str(tmp_path / "part.parquet")).selectExpr("p_partkey as page_id", "p_size % 3 as namespace", "p_name as title")
    found = plan(clean.linktarget_reasons(fx.linktarget, stored))
    assert found.count("BroadcastHashJoin") == 1 and found.count("SortMergeJoin") == 1
