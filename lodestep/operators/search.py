"""All shortest paths between pairs of pages, for many pairs at once.

The search goes level by level from both ends of every pair.  Its state is one
row for each (pair, direction, node) that was reached, with the depth and the
number of shortest ways there.  A round expands one side of each pair: the side
with fewer nodes in its last level.  Pairs stop on their own: when the sides
meet, or when a side has nothing left to expand.  Which side is expanded never
changes a result.

A search begins near: while all that it has reached is at most ``NEAR`` nodes, the
driver holds them, and a level is one job, in which the level before is broadcast
to the steps and the nodes one step on come back with their numbers of ways.  The
links of the paths then take one job more.  Few nodes can also be answered by a
lookup, which reads only the files that hold them.  When the nodes become more,
the search goes on far, from where it is.  Each round writes the new level and the
pairs' numbers to the shared folder; the driver gets sums only, however many pairs
there are.  Steps stay where they are, as lists sorted by their beginning, so a round
shuffles the frontier, the nodes one step on, and the state of the pairs that go
on; pairs that are done leave the state that is looked at.  What is shuffled goes to
as many partitions as it has rows for.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parts

COUNT = "decimal(38,0)"
#: Rows of a level or of pairs (44 bytes each at most) up to which they are broadcast, and levels after which the state is written as one table.
BROADCAST_ROWS, COMPACT = 100_000, 8
#: Pairs, and nodes or links of all of them, up to which the driver holds a search.
NEAR_PAIRS, NEAR = 500, 50_000
#: Nodes of a level up to which they are looked up, where there is a lookup.
LOOKUP = 500
#: Ends of steps in one list at most, so that a hub is no row.
LIST = 4096
#: Greatest number of paths that an answer can hold.
MOST = 2**63 - 1
_STATE = f"pair_id long, dir string, node long, depth int, cnt {COUNT}"


@dataclass
class Search:
    """Results of a search; ``links`` is computed when it is used."""

    summary: DataFrame
    links: DataFrame


def resolve_pairs(pairs: DataFrame, redirects: DataFrame) -> DataFrame:
    """(pair_id, source, source_is_redirect, target, target_is_redirect); unknown ids stay as they are."""
    a = redirects.select(F.col("source").alias("_a"), F.col("target").alias("_at"))
    b = redirects.select(F.col("source").alias("_b"), F.col("target").alias("_bt"))
    joined = pairs.join(a, F.col("source_in") == F.col("_a"), "left").join(b, F.col("target_in") == F.col("_b"), "left")
    return joined.select(
        "pair_id",
        F.coalesce("_at", "source_in").alias("source"),
        F.col("_at").isNotNull().alias("source_is_redirect"),
        F.coalesce("_bt", "target_in").alias("target"),
        F.col("_bt").isNotNull().alias("target_is_redirect"),
    )


def both_ways(graph: DataFrame) -> DataFrame:
    """(dir, a, b): every link as a step forwards and as a step backwards, kept."""
    return _both_ways(graph).persist(StorageLevel.MEMORY_AND_DISK)


def _both_ways(graph: DataFrame) -> DataFrame:
    forward = graph.select(F.lit("F").alias("dir"), F.col("source").alias("a"), F.col("target").alias("b"))
    back = graph.select(F.lit("B").alias("dir"), F.col("target").alias("a"), F.col("source").alias("b"))
    return forward.unionByName(back)


class Steps:
    """The steps of a graph.

    ``lookup`` gives (dir, a, b) of the steps from few nodes, forwards from those
    of its first list and backwards from those of its second; all steps are kept
    only when a level needs them.
    """

    def __init__(self, graph: DataFrame, lookup: Callable[[list[int], list[int]], DataFrame] | None = None, frame: DataFrame | None = None):
        self.graph, self.lookup, self._frame, self._placed = graph, lookup, frame, None
        self._ends = 1.0
        self._lock = threading.Lock()

    @property
    def frame(self) -> DataFrame:
        with self._lock:
            if self._frame is None:
                self._frame = both_ways(self.graph)
            return self._frame

    @property
    def placed(self) -> DataFrame:
        """(a, dir, ends): all steps as lists, kept by their beginning and sorted, so that a join with them shuffles only its other side."""
        with self._lock:
            if self._placed is None:
                every = _both_ways(self.graph) if self._frame is None else self._frame
                rows = every.count()
                dealt = every.repartition(parts(self.graph.sparkSession, rows), "a", "dir").sortWithinPartitions("a", "dir")
                # of so many rows one after another those of a beginning are a list
                lists = dealt.withColumn("_block", F.expr(f"monotonically_increasing_id() div {LIST}")).groupBy("a", "dir", "_block").agg(F.collect_list("b").alias("ends"))
                self._placed = lists.drop("_block").sortWithinPartitions("a", "dir").persist(StorageLevel.MEMORY_AND_DISK)
                self._ends = rows / max(1, self._placed.count())
            return self._placed

    def ahead(self, nodes: int) -> float:
        """About how many steps begin at so many nodes."""
        return nodes * max(1.0, self._ends)

    def near(self, nodes: set[tuple[str, int]]) -> DataFrame:
        """(dir, a, b) that hold all steps from the nodes (dir, node), and maybe others."""
        if self.lookup is None or len(nodes) > LOOKUP:
            return self.frame
        return self.lookup(*(sorted(n for d, n in nodes if d == way) for way in "FB"))

    def unpersist(self) -> None:
        with self._lock:
            if self._frame is not None:
                self._frame.unpersist()
                self._frame = None
        self.unplace()

    def unplace(self) -> None:
        with self._lock:
            if self._placed is not None:
                self._placed.unpersist()
                self._placed = None


def _check(stop: Callable[[], bool]) -> None:
    if stop():
        raise TimeoutError("the search was stopped")


def _expand(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """(pair_id, dir, node, depth, cnt) of the nodes one step on; ``depth`` is the frontier's own, which is to be theirs."""
    reached = frontier.join(steps, (F.col("node") == F.col("a")) & (frontier["dir"] == steps["dir"])).select("pair_id", frontier["dir"], F.col("b").alias("node"), "depth", "cnt")
    return reached.groupBy("pair_id", "dir", "node", "depth").agg(F.sum("cnt").cast(COUNT).alias("cnt"))


def _seeds(ends: DataFrame) -> DataFrame:
    """The state before the first round."""
    seeds = [ends.select("pair_id", F.lit(d).alias("dir"), F.col(c).alias("node"), F.lit(0).alias("depth"), F.lit(1).cast(COUNT).alias("cnt")) for d, c in (("F", "source"), ("B", "target"))]
    return seeds[0].unionByName(seeds[1])


def _turns(size: dict[tuple[int, str], int], met: set[int], force: str | None) -> list[tuple[int, str]]:
    """(pair, side) of those that go on: the side with fewer nodes in its last level."""
    chosen = []
    for pair in {p for p, _ in size} - met:
        f, b = size[pair, "F"], size[pair, "B"]
        if f and b:
            chosen.append((pair, force or ("F" if f < b else "B")))
    return chosen


class _Near:
    """A search that the driver holds: for each (pair, side) its nodes with depth and ways, and the last level's."""

    def __init__(self, ends: list[tuple[int, int, int]]):
        self.reached = {(p, d): {n: (0, 1)} for p, s, t in ends for d, n in (("F", s), ("B", t))}
        self.last = {side: dict.fromkeys(nodes, 1) for side, nodes in self.reached.items()}
        self.depth = dict.fromkeys(self.reached, 0)
        self.met = {p for p, s, t in ends if s == t}

    def size(self) -> dict[tuple[int, str], int]:
        return {side: len(level) for side, level in self.last.items()}

    def frame(self, spark, rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame([(p, d, n, k, Decimal(c)) for p, d, n, k, c in rows], _STATE)

    def state(self, spark) -> DataFrame:
        return self.frame(spark, [(p, d, n, k, c) for (p, d), nodes in self.reached.items() for n, (k, c) in nodes.items()])

    def run(self, spark, steps: Steps, force: str | None, stop: Callable[[], bool]) -> bool:
        """Go level by level; False if there are more than ``NEAR`` nodes, with the state before that level."""
        held = sum(map(len, self.reached.values()))
        while chosen := _turns(self.size(), self.met, force):
            _check(stop)
            rows = [(p, d, n, self.depth[p, d] + 1, c) for p, d in chosen for n, c in self.last[p, d].items()]
            found = _expand(F.broadcast(self.frame(spark, rows)), steps.near({(d, n) for _, d, n, _, _ in rows}))
            known = found.select("pair_id", "dir", "node", "cnt").limit(NEAR + 1).collect()
            if len(known) > NEAR or held > NEAR:
                return False
            level: dict[tuple[int, str], dict[int, int]] = {side: {} for side in chosen}
            for r in known:
                if r.node not in self.reached[r.pair_id, r.dir]:
                    level[r.pair_id, r.dir][r.node] = int(r.cnt)
            for (p, d), nodes in level.items():
                self.depth[p, d] += 1
                self.last[p, d] = nodes
                self.reached[p, d].update((n, (self.depth[p, d], c)) for n, c in nodes.items())
                held += len(nodes)
                if not nodes.keys().isdisjoint(self.reached[p, "B" if d == "F" else "F"]):
                    self.met.add(p)
        return True

    def meeting(self) -> dict[int, dict[int, tuple[int, int, int]]]:
        """For each pair that met the nodes of both sides: depths and the number of ways through each."""
        out = {}
        for p in self.met:
            f, b = self.reached[p, "F"], self.reached[p, "B"]
            out[p] = {n: (f[n][0], b[n][0], f[n][1] * b[n][1]) for n in f.keys() & b.keys()}
        return out

    def links(self, spark, steps: Steps) -> list[tuple[int, int, int]] | None:
        """(pair, source, target) of every link on a shortest path; None if one level has links to more than ``NEAR``.

        Steps between nodes of neighbouring depths come back from one job; those
        that end in a meeting node, or before one, are walked back here.
        """
        meeting = self.meeting()
        deepest = {(p, d): max(m[d == "B"] for m in nodes.values()) for p, nodes in meeting.items() for d in "FB"}
        # of the deepest level only the meeting nodes are on a path
        rows = [(p, d, n, k, 1) for p, nodes in meeting.items() for d in "FB" for n, (k, _) in self.reached[p, d].items() if k < deepest[p, d] or n in nodes]
        if not any(k for *_, k, _ in rows):
            return []
        nodes = self.frame(spark, rows).drop("cnt")
        child = nodes.select("pair_id", "dir", F.col("node").alias("b"), (F.col("depth") - 1).alias("depth"))
        parents = {(d, n) for p, d, n, k, _ in rows if k < deepest[p, d]}
        found = steps.near(parents).join(F.broadcast(nodes.withColumnRenamed("node", "a")), ["dir", "a"]).join(F.broadcast(child), ["pair_id", "dir", "b", "depth"])
        known = found.select("pair_id", "dir", "depth", "a", "b").distinct().limit(NEAR + 1).collect()
        if len(known) > NEAR:
            return None
        before = defaultdict(set)
        for r in known:
            before[r.pair_id, r.dir, r.depth + 1, r.b].add(r.a)
        out = set()
        for p, ways in meeting.items():
            for d in "FB":
                level, depth = set(ways), deepest[p, d]
                while depth:
                    walked = {(a, b) for b in level for a in before[p, d, depth, b]}
                    out |= {(p, a, b) if d == "F" else (p, b, a) for a, b in walked}
                    level, depth = {a for a, _ in walked}, depth - 1
        return sorted(out)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


_TURN = "case when not met and f > 0 and b > 0 then {} end"
_REACHED = f"pair_id long, node long, df int, db int, ways {COUNT}"


def _levels(ends: DataFrame, steps: Steps, force: str | None, stop: Callable[[], bool], near: _Near | None = None) -> tuple[DataFrame, DataFrame]:
    """All that was reached as (pair_id, dir, node, depth, cnt), and where the sides met as (pair_id, node, df, db, ways).

    ``near`` has what was reached already.  A side's level is new to it, and before
    the sides meet no node is on both; so one join with what is known tells both.
    """
    spark = ends.sparkSession
    if near is None:
        state = cut(_seeds(ends))
        met = ends.where("source = target").select("pair_id", F.col("source").alias("node"), F.lit(0).alias("df"), F.lit(0).alias("db"), F.lit(1).cast(COUNT).alias("ways"))
        sides = ends.select("pair_id", (F.col("source") == F.col("target")).alias("met"), *(F.lit(1).cast("long").alias(c) for c in "fb"), *(F.lit(0).alias(c) for c in ("df", "db")))
    else:
        state, size = cut(near.state(spark)), near.size()
        met = spark.createDataFrame([(p, n, f, b, Decimal(w)) for p, nodes in near.meeting().items() for n, (f, b, w) in nodes.items()], _REACHED)
        sides = spark.createDataFrame([(p, p in near.met, size[p, "F"], size[p, "B"], near.depth[p, "F"], near.depth[p, "B"]) for p, d in size if d == "F"], "pair_id long, met boolean, f long, b long, df int, db int")
    turn = F.expr(_TURN.format(f"'{force}'" if force else "case when f < b then 'F' else 'B' end"))
    sides = cut(sides.withColumn("turn", turn))
    hits, live, looked, levels = cut(met), state, None, 0
    while True:
        _check(stop)
        going = sides.where("turn is not null").select("pair_id", "turn", F.when(F.col("turn") == "F", F.col("df")).otherwise(F.col("db")).alias("at"))
        n, rows = sides.where("turn is not null").agg(F.count("*"), F.sum(F.when(F.col("turn") == "F", F.col("f")).otherwise(F.col("b")))).first()
        if not n:
            return state, hits
        lively, looked = live.join(_few(going.select("pair_id"), n), "pair_id", "left_semi"), looked or n
        if 2 * n <= looked or levels % COMPACT == COMPACT - 1:
            live = lively = cut(lively)
            looked = n
        # a side's last level is what the state holds at its depth
        now = live.join(_few(going, n), "pair_id").where("dir = turn and depth = at").select("pair_id", "dir", "node", (F.col("at") + 1).alias("depth"), "cnt")
        # the steps stay where they are; a large level is shuffled to them
        placed = steps.placed
        ahead = _step(_few(now, rows), placed, F.col("dir")).withColumn("_f", F.col("dir") == "F").repartition(parts(spark, steps.ahead(rows)), "pair_id", "node")
        found = ahead.groupBy("pair_id", "node").agg(F.max("_f").alias("_f"), F.max("depth").alias("depth"), F.sum("cnt").cast(COUNT).alias("cnt"))
        found = found.withColumn("dir", F.when(F.col("_f"), "F").otherwise("B")).drop("_f")
        known = lively.select("pair_id", "node", F.col("dir").alias("_dir"), F.col("depth").alias("_depth"), F.col("cnt").alias("_cnt"))
        # the new level is written once, and what else is asked is taken from that
        written = cut(found.join(known, ["pair_id", "node"], "left").where("_dir is null or _dir <> dir"))
        new, meets = written.select(*state.columns), written.where("_dir is not null")
        forward = F.col("dir") == "F"
        hits = hits.unionByName(meets.select("pair_id", "node", F.when(forward, F.col("depth")).otherwise(F.col("_depth")).alias("df"), F.when(forward, F.col("_depth")).otherwise(F.col("depth")).alias("db"), (F.col("cnt") * F.col("_cnt")).cast(COUNT).alias("ways")))
        counts = written.coalesce(spark.sparkContext.defaultParallelism).groupBy("pair_id").agg(F.count("*").alias("n"), F.count("_dir").alias("hits"))
        grown = sides.join(counts, "pair_id", "left")
        ours = lambda d: F.coalesce(F.col("turn") == d, F.lit(False))
        grown = grown.select(
            "pair_id", (F.col("met") | (F.coalesce("hits", F.lit(0)) > 0)).alias("met"),
            *(F.when(ours(d), F.coalesce("n", F.lit(0))).otherwise(F.col(d.lower())).alias(d.lower()) for d in "FB"),
            *((F.col(f"d{d.lower()}") + ours(d).cast("int")).alias(f"d{d.lower()}") for d in "FB"),
        )
        sides = cut(grown.withColumn("turn", turn))
        state, live, levels = state.unionByName(new), live.unionByName(new), levels + 1
        if levels % COMPACT == 0:
            state, hits = cut(state), cut(hits)


def _step(nodes: DataFrame, placed: DataFrame, way) -> DataFrame:
    """``nodes`` one step on in the direction ``way``: ``node`` is the step's end, ``before`` its beginning."""
    asked = nodes.withColumn("_way", way)
    ahead = placed.withColumnRenamed("dir", "_dir")
    found = asked.join(ahead, (F.col("node") == F.col("a")) & (F.col("_way") == F.col("_dir")))
    return found.select(*(c for c in nodes.columns if c != "node"), F.col("a").alias("before"), F.explode("ends").alias("node"))


def _links(state: DataFrame, steps: Steps, meeting: DataFrame, stop: Callable[[], bool]) -> DataFrame:
    """(pair_id, source, target) of every link on a shortest path: from the meeting nodes back along both sides."""
    ends = cut(meeting.groupBy("pair_id").agg(F.max("df").alias("_f"), F.max("db").alias("_b")))
    # of a side's last level only the meeting nodes are on a path
    reached = state.join(_few(ends, ends.count()), "pair_id").where("depth < case dir when 'F' then _f else _b end")
    reached = cut(reached.select("pair_id", "dir", F.col("node").alias("parent"), F.col("depth").alias("parent_depth")))
    inner = reached.count()
    current = cut(meeting.select("pair_id", F.lit("F").alias("dir"), "node", F.col("df").alias("depth")).unionByName(meeting.select("pair_id", F.lit("B").alias("dir"), "node", F.col("db").alias("depth"))).where("depth > 0"))
    out, rows = None, 0
    while n := current.count():
        _check(stop)
        # back along a side is a step of the other direction
        walked = _step(_few(current, n), steps.placed, F.when(F.col("dir") == "F", "B").otherwise("F"))
        walked = walked.select("pair_id", "dir", F.col("before").alias("node"), F.col("node").alias("parent"), (F.col("depth") - 1).alias("parent_depth"))
        keys = ["pair_id", "dir", "parent", "parent_depth"]
        if inner > BROADCAST_ROWS:
            walked = walked.repartition(parts(walked.sparkSession, max(inner, steps.ahead(n))), *keys)
        walked = cut(walked.join(_few(reached, inner), keys).distinct())
        found = walked.select(
            "pair_id", F.when(F.col("dir") == "F", F.col("parent")).otherwise(F.col("node")).alias("source"), F.when(F.col("dir") == "F", F.col("node")).otherwise(F.col("parent")).alias("target")
        )
        out, rows = found if out is None else out.unionByName(found), rows + n
        current = cut(walked.where("parent_depth > 0").select("pair_id", "dir", F.col("parent").alias("node"), F.col("parent_depth").alias("depth")).distinct())
    empty = meeting.where("false").select("pair_id", F.col("node").alias("source"), F.col("node").alias("target"))
    return empty if out is None else out.coalesce(parts(out.sparkSession, rows))


def _near_ends(pairs: DataFrame, redirects: DataFrame) -> list[tuple] | None:
    """The rows of ``resolve_pairs`` for few pairs; None for many."""
    asked = pairs.select("pair_id", "source_in", "target_in").limit(NEAR_PAIRS + 1).collect()
    if len(asked) > NEAR_PAIRS or any(None in r for r in asked) or len({r.pair_id for r in asked}) < len(asked):
        return None
    ids = sorted({x for r in asked for x in r[1:]})
    moved = {r.source: r.target for r in redirects.where(F.col("source").isin(ids)).select("source", "target").collect()}
    return [(r.pair_id, moved.get(r.source_in, r.source_in), r.source_in in moved, moved.get(r.target_in, r.target_in), r.target_in in moved) for r in asked]


_ENDS = "pair_id long, source long, source_is_redirect boolean, target long, target_is_redirect boolean"


def shortest_paths(graph: DataFrame, redirects: DataFrame, pairs: DataFrame, force: str | None = None, with_links: bool = True, steps: DataFrame | Steps | None = None, stop: Callable[[], bool] = lambda: False) -> Search:
    """Search all pairs (pair_id, source_in, target_in).

    ``summary`` has (pair_id, source, source_is_redirect, target,
    target_is_redirect, length, count) and ``links`` (pair_id, source, target).
    A pair without a path has length 0 and count 0; one whose ends are the same
    page, known or not, has length 0 and count 1.  Counts are exact; one beyond
    64 bits is an error.  ``force`` ("F" or "B") expands one side only.
    ``steps`` is ``both_ways`` of the graph, or ``Steps``, for callers that keep
    it; what is made here is given back.  ``stop`` is asked before each round; if
    it says so, TimeoutError is raised.
    """
    spark, own, lent = graph.sparkSession, steps is None, isinstance(steps, DataFrame)
    steps = steps if isinstance(steps, Steps) else Steps(graph, frame=steps)
    try:
        known = _near_ends(pairs, redirects)
        near = None
        if known is not None:
            near = _Near([(p, s, t) for p, s, _, t, _ in known])
            if near.run(spark, steps, force, stop):
                links = near.links(spark, steps) if with_links else []
                if links is not None:
                    return _near_results(spark, known, near, links)
            ends = spark.createDataFrame(known, _ENDS)
        else:
            ends = cut(resolve_pairs(pairs, redirects))
        return _far(ends, near, steps, force, with_links, stop)
    finally:
        if own:  # all rounds are written
            steps.unpersist()
        elif lent:
            steps.unplace()


def _near_results(spark, known: list[tuple], near: _Near, links: list[tuple[int, int, int]]) -> Search:
    rows, meeting = [], near.meeting()
    for row in known:
        ways = meeting.get(row[0], {})
        count = sum(w for _, _, w in ways.values())
        if count > MOST:
            raise OverflowError(f"pair {row[0]} has {count} paths")
        rows.append((*row, max((f + b for f, b, _ in ways.values()), default=0), count))
    return Search(spark.createDataFrame(rows, f"{_ENDS}, length int, count long"), spark.createDataFrame(links, "pair_id long, source long, target long"))


def _far(ends: DataFrame, near: _Near | None, steps: Steps, force: str | None, with_links: bool, stop: Callable[[], bool]) -> Search:
    state, met = _levels(ends, steps, force, stop, near)
    meeting = cut(met)
    total = meeting.groupBy("pair_id").agg(F.max(F.col("df") + F.col("db")).alias("length"), F.sum("ways").cast(COUNT).alias("count"))
    summary = ends.join(total, "pair_id", "left").select(*ends.columns, F.coalesce("length", F.lit(0)).cast("int").alias("length"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    links = _links(state, steps, meeting, stop) if with_links else meeting.where("false").select("pair_id", F.col("node").alias("source"), F.col("node").alias("target"))
    return Search(summary, links)


def levels(graph: DataFrame, start: int) -> DataFrame:
    """(node, depth) of every node that can be reached from ``start``."""
    spark = graph.sparkSession
    steps = both_ways(graph)
    forward, ids = steps.where("dir = 'F'").select("a", "b"), "node long, depth int"
    held, last, depth = {start: 0}, [start], 0
    while last and len(held) <= NEAR:  # held by the driver while they are few
        level = F.broadcast(spark.createDataFrame([(n,) for n in last], "a long"))
        found = [r.b for r in forward.join(level, "a").select("b").distinct().limit(NEAR + 1).collect()]
        if len(found) > NEAR:
            break
        depth += 1
        last = [n for n in found if n not in held]
        held.update(dict.fromkeys(last, depth))
    state = spark.createDataFrame(list(held.items()), ids)
    if not last:
        steps.unpersist()
        return state
    state = cut(state)
    frontier = state.where(F.col("depth") == depth)
    while True:
        depth += 1
        new = frontier.join(forward, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(state, "node", "left_anti")
        new = cut(new.select("node", F.lit(depth).alias("depth")))
        if new.isEmpty():
            steps.unpersist()
            return state
        state, frontier = state.unionByName(new), new


def adjacency(search: Search) -> DataFrame:
    """(pair_id, source, targets): the links grouped by source, as in a response."""
    return search.links.groupBy("pair_id", "source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def records(search: Search, language_code: str, date_code: str) -> DataFrame:
    """One response per pair: the summary with links as a map from id, as text, to ids, and the database's name parts."""
    maps = adjacency(search).groupBy("pair_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source").cast("string").alias("k"), "targets")))).alias("links"))
    return search.summary.join(maps, "pair_id", "left").select(
        "pair_id",
        "source",
        "source_is_redirect",
        "target",
        "target_is_redirect",
        F.coalesce("links", F.create_map().cast("map<string,array<bigint>>")).alias("links"),
        F.lit(language_code).alias("language_code"),
        F.lit(date_code).alias("date_code"),
        "length",
        "count",
    )


def to_json(responses: DataFrame) -> DataFrame:
    """(pair_id, json) with the field names of the public interface."""
    names = {"source_is_redirect": "sourceIsRedirect", "target_is_redirect": "targetIsRedirect", "language_code": "languageCode", "date_code": "dateCode"}
    fields = [F.col(c).alias(names.get(c, c)) for c in responses.columns if c != "pair_id"]
    return responses.select("pair_id", F.to_json(F.struct(*fields)).alias("json"))
