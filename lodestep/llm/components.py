"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Scratch


#: Edges up to which a round's minima (16 bytes a node) are broadcast.
BROADCAST_EDGES = 500_000
#: Neighbours from which a node's minimum is broadcast anyway; there are at most 2 / HUB as many such nodes as edges.
HUB = 10_000


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with the minimum ``m`` of u; ``least`` has (u, m, degree)."""
    if few:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    hubs = F.broadcast(least.where(F.col("degree") >= HUB).select("u", "m"))
    rest = least.where(F.col("degree") < HUB).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, least) for every node with an edge: the least node that it reaches.

    ``edges`` has columns a and b.  Large-star links every greater neighbour of
    a node to the least node of its neighbourhood, small-star every lesser one;
    together they turn each component into a star in a logarithmic number of
    rounds.  A round's minima are pre-aggregated and broadcast, all of them while
    they are few and else those of hubs, so a node with very many neighbours is
    no single task; each round is a written table.
    """
    current = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, i = None, 0
    while True:
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now.n, now.h):
            return current.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("least"))).distinct()
        state = (now.n, now.h)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = now.n <= BROADCAST_EDGES
        i += 1
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least if few else scratch.table(least, f"{name}-{i}-least"), few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else scratch.table(large, f"{name}-{i}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = _with_least(large, low if few else scratch.table(low, f"{name}-{i}-low"), few).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = scratch.table(small, f"{name}-{i}")
        scratch.drop(*(f"{name}-{x}" for x in (i - 1, f"{i}-least", f"{i}-large", f"{i}-low")))
