"""Paths by their numbers, and samples of them."""

from collections import Counter

from lodestep.operators import paths, search

SUMMARY = "pair_id long, source long, source_is_redirect boolean, target long, target_is_redirect boolean, length int, count long"


def layered(spark, layers, width=10):
    """A pair whose paths choose one of ``width`` pages in each layer; a pair of equal ends; and one without paths."""
    links, above = [], [1]
    for i in range(1, layers + 1):
        here = [100 * i + j for j in range(10, 10 + width)]
        links += [(1, a, b) for a in above for b in here]
        above = here
    links += [(1, a, 2) for a in above]
    summary = [(1, 1, False, 2, False, layers + 1, width**layers), (2, 7, False, 7, False, 0, 1), (3, 8, False, 9, False, 0, 0)]
    return search.Search(spark.createDataFrame(summary, SUMMARY), spark.createDataFrame(links, "pair_id long, source long, target long"))


def test_numbers_of_a_hundred_million_paths(spark):
    found = layered(spark, 8)
    wanted = [1, 2, 10, 11, 12_345_678, 99_999_999, 100_000_000]
    asked = [(1, k) for k in [*wanted, *wanted, 0, -1, 100_000_001, None]] + [(2, 1), (2, 2), (3, 1), (4, 1), (None, 1)]
    got = {(r.pair_id, r.rank): r.path for r in paths.numbered_paths(found, spark.createDataFrame(asked, "pair_id long, rank long")).collect()}
    digits = {k: [100 * (i + 1) + 10 + int(d) for i, d in enumerate(f"{k - 1:08}")] for k in wanted}
    assert got == {(1, k): [1, *d, 2] for k, d in digits.items()} | {(2, 1): [7]}


def test_each_number_is_the_place_in_the_list(spark):
    """Ids whose order as text isn't that as numbers."""
    links = [(1, 1, b) for b in (9, 10, 100)] + [(1, a, c) for a in (9, 100) for c in (20, 3)] + [(1, 10, 3)] + [(1, c, 5) for c in (20, 3)]
    found = search.Search(spark.createDataFrame([(1, 1, False, 5, False, 3, 5)], SUMMARY), spark.createDataFrame(links, "pair_id long, source long, target long"))
    listed = {(r.pair_id, r.rank): r.path for r in paths.enumerate_paths(found, None).collect()}
    got = {(r.pair_id, r.rank): r.path for r in paths.numbered_paths(found, spark.createDataFrame([(1, k) for k in range(1, 6)], "pair_id long, rank long")).collect()}
    assert got == listed and len(got) == 5


def test_samples(spark):
    found = layered(spark, 2, 3)
    got = paths.sample_paths(found, 4, seed=1).collect()
    assert len({tuple(r.path) for r in got if r.pair_id == 1}) == 4 and [r.path for r in got if r.pair_id == 2] == [[7]] and len(got) == 5
    assert sorted((r.pair_id, r.rank) for r in paths.sample_paths(found, 4, seed=1).collect()) == sorted((r.pair_id, r.rank) for r in got)
    assert paths.sampled_numbers(found.summary, 9).count() == 10 and paths.sampled_numbers(found.summary.where("false")).count() == 0


def test_every_set_is_as_likely(spark):
    """Two of five, for 4,000 pairs: ten sets, some 400 times each."""
    pairs = spark.range(4000).selectExpr("id as pair_id", "5L as count")
    sets = Counter()
    held = {}
    for r in paths.sampled_numbers(pairs, 2).collect():
        held.setdefault(r.pair_id, set()).add(r.rank)
    for s in held.values():
        sets[tuple(sorted(s))] += 1
    assert len(sets) == 10 and all(320 < n < 480 for n in sets.values()), sets
