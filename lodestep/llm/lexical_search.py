"""Ranked lexical search: the best documents for each query text, exactly.

Documents become rows of their counts of the queries' terms, once for a group of
queries whose terms are broadcast.  From these rows come the corpus counts, and
then each task puts its documents into trees over document ranges: the leaves are
blocks of ``BLOCK`` documents, a node has ``FAN`` children, and for each term a
node holds the largest impact in its range.  For a query, a node's bound is the
sum over its terms of weight times that maximum.  Nodes are opened best first,
and the search of a tree ends when the best bound left is below the query's k-th
score so far; a node whose bound equals it is opened, since a document of the
same score and a smaller id goes first.  What a task has found is carried from
tree to tree, and its best k for each query are merged in two steps, so that no
task gathers the rows of all others.

The score is that of the contract: all but the weights' logarithm is integer
arithmetic.  Null texts and texts without terms are no documents; queries
without terms, or null, find nothing; a term counts once a query.  Each row is a
document and each query row a query, repeated ids included.  Equal scores go by
ascending id, null ids last.  Empty tables give an empty one.  Whole texts are
counted, however long; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .session import Scratch, ensure_importable

#: Documents of a leaf, children of a node, and pairs of document and term of a tree.
BLOCK, FAN, TREE_PAIRS = 64, 8, 1 << 20
#: Bytes of query texts that are searched for together; their terms are broadcast.
GROUP_BYTES = 8 << 20


class Trees:
    """The trees of some documents, one max tree for each term that they hold."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """Documents' pairs of (term, impact); document i has those from ``starts[i]`` to ``starts[i + 1]``, at least one."""
        self.starts, self.impacts = starts, impacts
        self.known, self.terms = np.unique(terms, return_inverse=True)
        n, docs = len(self.known), len(starts) - 1
        block = np.repeat(np.arange(docs) // BLOCK, np.diff(starts))
        cell = block * n + self.terms
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        level = np.zeros((-(-docs // BLOCK), n), np.int64)
        level.ravel()[cell[order][first]] = np.maximum.reduceat(impacts[order], first)
        self.levels = [level]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))
        self.weight = np.zeros(n, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], k: int, key) -> None:
        """Put the documents that belong there into ``best``, sorted (-score, key of document) of at most ``k``."""
        at = np.searchsorted(self.known, terms)
        at[at == len(self.known)] = 0
        here = self.known[at] == terms
        at, weights = at[here], weights[here]
        if not len(at):
            return
        self.weight[at] = weights
        top = len(self.levels) - 1
        queue = [(-int(self.levels[top][0, at] @ weights), top, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if not bound or len(best) == k and bound > best[-1][0]:
                break
            if level:
                first = node * FAN
                bounds = self.levels[level - 1][first : first + FAN][:, at] @ weights
                worst = best[-1][0] if len(best) == k else 0
                for i, b in enumerate(bounds.tolist()):
                    if b and -b <= worst:
                        heapq.heappush(queue, (-b, level - 1, first + i))
            else:
                a, b = node * BLOCK, min((node + 1) * BLOCK, len(self.starts) - 1)
                pairs = slice(self.starts[a], self.starts[b])
                scores = np.add.reduceat(self.weight[self.terms[pairs]] * self.impacts[pairs], self.starts[a:b] - self.starts[a])
                for i in np.flatnonzero(scores >= (-best[-1][0] if len(best) == k else 1)).tolist():
                    found = (-int(scores[i]), key(a + i))
                    if len(best) < k or found < best[-1]:
                        insort(best, found)
                        del best[k:]
        self.weight[at] = 0


def _profiles(docs: DataFrame, id_: str, text: str, terms: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): each document's number of terms, and those of ``terms`` in it with their counts, packed."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            keep, n, held, counts = [], [], [], []
            for i, raw in enumerate(words.texts(batch.column(1))):
                seen: Counter[bytes] = Counter()
                for part in words.pieces(raw):
                    seen.update(part)
                if not seen:
                    continue
                own = sorted((known[t], c) for t, c in seen.items() if t in known)
                keep.append(i)
                n.append(seen.total())
                held.append(np.array([t for t, _ in own], "<i4").tobytes())
                counts.append(np.array([c for _, c in own], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())], ["id", "n", "terms", "counts"])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(profile, f"id {kind}, n long, terms binary, counts binary")


def _frequencies(profiles: DataFrame, terms: int) -> dict[int, int]:
    """The number of documents that hold each term; what comes back has a row a term at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total[np.frombuffer(packed.as_py(), "<i4")] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    rows = profiles.select("terms").mapInArrow(tally, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term: r.df for r in rows}


def impacts(n: np.ndarray, tf: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Of counts ``tf`` in documents of ``n`` terms, among ``docs`` documents of ``length`` terms together."""
    if 50 * docs * int(n.max(initial=0)) < 1 << 62:
        m = 50 + 50 * n * docs // length
    else:
        m = np.array([50 + 50 * int(x) * docs // length for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _best(profiles: DataFrame, kind: str, wanted: list[tuple[np.ndarray, np.ndarray]], docs: int, length: int, k: int) -> DataFrame:
    """(query, id, score): each task's best documents for each query."""
    sent = profiles.sparkSession.sparkContext.broadcast(wanted)
    schema = profiles.select("id").schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in sent.value]

        def run(ids: list, n: list[int], held: list[np.ndarray], counts: list[np.ndarray]) -> None:
            sizes = np.array(list(map(len, held)))
            tree = Trees(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(held), impacts(np.repeat(np.array(n, np.int64), sizes), np.concatenate(counts), docs, length))
            key = lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i])
            for (terms, weights), own in zip(sent.value, best):
                tree.search(terms, weights, own, k, key)

        part: tuple[list, ...] = ([], [], [], [])
        pairs, id_type = 0, pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for id_, n, held, counts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held:
                    for to, value in zip(part, (id_, n, np.frombuffer(held, "<i4"), np.frombuffer(counts, "<i8"))):
                        to.append(value)
                    pairs += len(part[2][-1])
                    if pairs >= TREE_PAIRS:
                        run(*part)
                        part, pairs = ([], [], [], []), 0
        if pairs:
            run(*part)
        rows = [(q, None if none else i, -s) for q, own in enumerate(best) for s, (none, i) in own]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type), pa.array(s, pa.int64())], ["query", "id", "score"])

    return profiles.select("id", "n", "terms", "counts").mapInArrow(search, f"query int, id {schema['id'].dataType.simpleString()}, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with their rank; first of some tasks' rows, then of theirs."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = Window.partitionBy("query", "part").orderBy(*order)
    some = found.withColumn("part", F.spark_partition_id() % max(1, math.isqrt(found.sparkSession.sparkContext.defaultParallelism * 4)))
    some = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank", "part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 50) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each query with a score above 0, best first."""
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark, "search")
    kind, item_kind = docs.schema[id_].dataType.simpleString(), queries.schema[item].dataType.simpleString()
    asked = scratch.table(queries.select(F.col(item).alias("item"), F.coalesce(item_text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    out = spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score long")
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).collect()  # texts of some GROUP_BYTES
        own = [sorted({t for part in words.pieces(r.text.encode()) for t in part}) for r in rows]
        terms = {t: i for i, t in enumerate(sorted(set().union(*own)))}
        if not terms:
            continue
        profiles = scratch.table(_profiles(docs, id_, text, terms), f"profiles-{g}")
        total = profiles.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not total.n:
            break
        df = _frequencies(profiles, len(terms))
        weight = np.zeros(len(terms), np.int64)
        for t, f in df.items():
            weight[t] = math.floor(1000 * math.log((2 * total.n + 2) / (2 * f + 1)))
        wanted = []
        for names in own:
            at = np.array([terms[t] for t in names], np.int64)
            at = at[weight[at] > 0]
            wanted.append((at, weight[at]))
        found = _merged(_best(profiles, kind, wanted, total.n, total.length, k), k)
        names = F.broadcast(spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"query int, item {item_kind}"))
        found = scratch.table(found.join(names, "query").select("item", F.col("rank").cast("int").alias("rank"), "id", "score"), f"found-{g}")
        scratch.drop(f"profiles-{g}")
        out = found if groups == 1 else out.unionByName(found)
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(id_), "score")
