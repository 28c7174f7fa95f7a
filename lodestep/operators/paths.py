"""Concrete paths from the links of a search, their titles, and the tables of a graph view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import summary as summary_text
from ..session import cut
from .search import Search

#: Paths shown unless asked otherwise.
SHOWN = 8


def text_order(path: Column) -> Column:
    """Paths go by their ids compared as text."""
    return F.transform(path, lambda x: x.cast("string"))


def _first(paths: DataFrame, most: int | None) -> DataFrame:
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(text_order(F.col("path")))))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def enumerate_paths(search: Search, most: int | None = SHOWN) -> DataFrame:
    """(pair_id, rank, path): the first ``most`` paths of each pair, or all.

    Paths grow by a link per level, and after each level only the first ``most``
    beginnings of a pair stay.  Every beginning ends in at least one path, so a
    beginning past that rank can only give paths past it.
    """
    found = search.summary.where("count > 0").select("pair_id", "source", "length")
    current = cut(found.select("pair_id", "length", F.array("source").alias("path")))
    longest = found.agg(F.max("length").alias("n")).first().n or 0
    links = search.links.select("pair_id", F.col("source").alias("_s"), F.col("target").alias("_t"))
    out = current.where("length = 0").select("pair_id", "path")
    for level in range(1, longest + 1):
        grown = current.where(F.col("length") >= level).join(links, (current["pair_id"] == links["pair_id"]) & (F.element_at("path", -1) == F.col("_s")))
        grown = grown.select(current["pair_id"], "length", F.concat("path", F.array("_t")).alias("path"))
        if most is not None:
            grown = _first(grown, most).drop("rank")
        current = cut(grown)
        out = out.unionByName(current.where(F.col("length") == level).select("pair_id", "path"))
    return _first(out, most).select("pair_id", "rank", "path")


def suffix_counts(search: Search) -> DataFrame:
    """(pair_id, node, paths): in how many ways each node of the links reaches its pair's target.

    Counted backwards from the targets.  All ways from a node are equally long, so a
    round has all of a node's links, and the counts of the round before suffice.
    """
    found = search.summary.where("count > 0")
    longest = found.agg(F.max("length").alias("n")).first().n or 0
    links = search.links.select("pair_id", F.col("source").alias("node"), F.col("target").alias("_t"))
    level = found.select("pair_id", F.col("target").alias("node"), F.lit(1).cast("long").alias("paths"))
    out = level
    for _ in range(longest):
        level = cut(links.join(level.withColumnRenamed("node", "_t"), ["pair_id", "_t"]).groupBy("pair_id", "node").agg(F.sum("paths").alias("paths")))
        out = out.unionByName(level)
    return out


def numbered_paths(search: Search, numbers: DataFrame) -> DataFrame:
    """(pair_id, rank, path): the paths of these numbers (pair_id, rank), counted from 1 in the order of ``enumerate_paths``.

    No other path is made: at each node, the numbers of ways on from its links, in
    text order, tell which link the number falls into.  Numbers that a pair doesn't
    have, null and repeated ones included, add no row.
    """
    found = search.summary.where("count > 0").select("pair_id", "source", "length", "count")
    longest = found.agg(F.max("length").alias("n")).first().n or 0
    asked = numbers.select("pair_id", F.col("rank").cast("long").alias("rank")).distinct().join(found, "pair_id").where("rank between 1 and count")
    current = cut(asked.select("pair_id", "rank", "length", (F.col("rank") - 1).alias("left"), F.array("source").alias("path")))
    out = current.where("length = 0").select("pair_id", "rank", "path")
    if not longest:
        return out
    ways = search.links.join(suffix_counts(search).withColumnRenamed("node", "target"), ["pair_id", "target"])
    so_far = F.sum("paths").over(Window.partitionBy("pair_id", "source").orderBy(F.col("target").cast("string")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = cut(ways.select(F.col("pair_id").alias("_p"), F.col("source").alias("_s"), F.col("target").alias("_t"), "paths", so_far.alias("_high")).withColumn("_low", F.col("_high") - F.col("paths")))
    for level in range(1, longest + 1):
        into = (F.col("pair_id") == F.col("_p")) & (F.element_at("path", -1) == F.col("_s")) & (F.col("left") >= F.col("_low")) & (F.col("left") < F.col("_high"))
        grown = current.where(F.col("length") >= level).join(steps, into)
        current = cut(grown.select("pair_id", "rank", "length", (F.col("left") - F.col("_low")).alias("left"), F.concat("path", F.array("_t")).alias("path")))
        out = out.unionByName(current.where(F.col("length") == level).select("pair_id", "rank", "path"))
    return out


def sampled_numbers(summary: DataFrame, most: int = SHOWN, seed: int = 0) -> DataFrame:
    """(pair_id, rank): ``most`` different numbers of each pair's paths, every set of them as likely as any, or all if there are no more.

    The i-th draw is from the first ``count - most + i`` numbers; one that was drawn gives way to the last of these.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pair_id").cast("string"), F.col("i").cast("string"))), 1, 15), 16, 10).cast("long")
    last = F.col("count") - most + F.col("i")
    drawn = summary.where(F.col("count") > most).select("pair_id", "count", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("i"))
    drawn = drawn.select("pair_id", F.struct("i", last.alias("last"), (draw % last + 1).alias("rank")).alias("d")).groupBy("pair_id").agg(F.array_sort(F.collect_list("d")).alias("d"))
    new = lambda got, d: F.concat(got, F.array(F.when(F.array_contains(got, d["rank"]), d["last"]).otherwise(d["rank"])))
    some = drawn.select("pair_id", F.explode(F.aggregate("d", F.array().cast("array<bigint>"), new)).alias("rank"))
    few = summary.where((F.col("count") > 0) & (F.col("count") <= most))
    return some.unionByName(few.select("pair_id", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("rank")))


def sample_paths(search: Search, most: int = SHOWN, seed: int = 0) -> DataFrame:
    """(pair_id, rank, path): a uniform sample of ``most`` paths of each pair, or all; with the same seed, the same."""
    return numbered_paths(search, sampled_numbers(search.summary, most, seed))


def with_titles(paths: DataFrame, page: DataFrame) -> DataFrame:
    """(pair_id, rank, position, page_id, title); a page without a row has no title."""
    steps = paths.select("pair_id", "rank", F.posexplode("path").alias("position", "page_id"))
    known = page.select("page_id", "title")
    return steps.join(known, "page_id", "left").select("pair_id", "rank", "position", "page_id", "title")


def pages_to_fetch(paths: DataFrame) -> DataFrame:
    """Distinct page ids of the paths, each pair's in the order of first appearance."""
    return paths.select("pair_id", "rank", F.posexplode("path").alias("position", "page_id")).groupBy("pair_id", "page_id").agg(F.min(F.struct("rank", "position")).alias("first"))


def titled_arrays(titled: DataFrame) -> DataFrame:
    """(pair_id, rank, pages): each path as an array of (id, title)."""
    step = F.struct("position", F.col("page_id").alias("id"), "title")
    ordered = F.array_sort(F.collect_list(step))
    return titled.groupBy("pair_id", "rank").agg(F.transform(ordered, lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"))).alias("pages"))


def view_nodes(titled: DataFrame, summary: DataFrame) -> DataFrame:
    """(pair_id, id, title, degree, label): the nodes of a graph view; ends that were redirects say so."""
    nodes = titled.groupBy("pair_id", F.col("page_id").alias("id")).agg(F.min("title").alias("title"), F.min("position").alias("degree"))
    ends = summary.select("pair_id", "source", "source_is_redirect", "target", "target_is_redirect")
    moved = ((F.col("id") == F.col("source")) & F.col("source_is_redirect")) | ((F.col("id") == F.col("target")) & F.col("target_is_redirect"))
    return nodes.join(ends, "pair_id").select("pair_id", "id", "title", "degree", F.concat("title", F.when(moved, " (redirected)").otherwise("")).alias("label"))


def view_edges(paths: DataFrame) -> DataFrame:
    """(pair_id, source, target): a row for each step of each path, repeated where paths share steps."""
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("source"), F.element_at("path", i + 1).alias("target")))
    return paths.where(F.size("path") > 1).select("pair_id", F.explode(step).alias("s")).select("pair_id", "s.source", "s.target")


def urls(page: DataFrame, language_code: str) -> DataFrame:
    return page.select("page_id", names.page_url(language_code, F.col("title")).alias("url"))


def texts(summary: DataFrame, paths: DataFrame) -> DataFrame:
    """(pair_id, text): what a user is told about each pair."""
    shown = paths.groupBy("pair_id").agg(F.count("*").alias("shown"))
    joined = summary.join(shown, "pair_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    return joined.select("pair_id", summary_text(F.col("length"), F.col("count"), F.col("shown")).alias("text"))
