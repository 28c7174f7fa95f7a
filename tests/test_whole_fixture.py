"""Lookups and searches that grow with the tables."""

import os

import pytest

from lodestep.plans import queries
from lodestep.plans.fixtures import PAIRS, UNKNOWN, Fixture

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_page_is_looked_up(spark):
    pages = {r.page_id for r in Fixture(spark, SF).page.collect()}
    assert len(pages) > 200
    assert {r.page_id for r in queries.queries()["lookup_redirect"](spark, SF).collect()} == pages | set(UNKNOWN)


def test_pairs_take_every_hundredth_page(spark):
    pages = {r.page_id for r in Fixture(spark, SF).page.collect() if r.page_id % 100 == 0}
    pairs = Fixture(spark, SF).all_pairs.collect()
    assert len({p.pair_id for p in pairs}) == len(pairs) == len(pages) + len(PAIRS)
    assert {p.source_in for p in pairs if p.pair_id >= 1000} == {p.target_in for p in pairs if p.pair_id >= 1000} == pages
