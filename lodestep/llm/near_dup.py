"""Near-duplicate documents by bottom-k sketches, with exact verification.

A document's set holds its distinct word shingles, as 63-bit hashes of one hash
function.  Its sketch is the ``K`` least of them: for sets of at most K
shingles, the set itself.  Documents of equal sets form a class, and only one of
a class goes on.

Inverted lists are keyed by runs of neighbours in a sketch, three at similarity
0.8.  In the sorted union of two sketches, common values in a row are neighbours
in both, and nowhere else does a key say so much: documents that share only
frequent shingles, or a passage, share few or none.  The length of the runs
follows from the similarity: the longest, of three at most, that a union of K
values lacks with a probability of ``MISSED`` at most (at 0.8 and below three:
4e-7).  Whole sets always have a common run, as small ones get shorter runs too.
A similarity that no run serves is refused.

A list is not expanded into pairs.  First its members meet two pivots (the
member whose lists are longest, at the heart of a group of copies, and one by
hash); each pair is estimated on the union sketch and verified on the full sets,
and the links make components.  What is left are lists whose members lie in
several components.  Of those, lists of at most ``SHORT`` members are joined
with themselves across components, and all these pairs are tested.  The members
of longer ones are compared exactly another way: by prefix filtering on their
full sets, rare shingles first, with bounds by position and size, so that
documents around one common text don't meet in pairs.

So all pairs with a common list are either in one component or tested, and what
any task holds is bounded by the longest document.  The estimate rules out a
pair of similarity 0.8 with a probability of about 1e-7.

Ids are whole numbers; others are refused.  Null ids are taken for ids beyond
all others; their rows join groups but never name one.  Rows with the same id
count as one document for links.  Null and empty texts link with nothing; an
empty table gives an empty one; whole texts are shingled, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from . import shingles
from .components import components
from .session import Scratch, unused

#: What separates words.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
K, SHORT = 42, 64
#: Probability that a pair of the asked similarity has no common run, at most.
MISSED = 1e-6
#: Standard deviations that a union-sketch estimate may fall short.
SPREAD = 6.0
#: Listed shingles of a document that tell whether two documents met already by a rarer one.
FIRST = 64
#: Rows of a few numbers (24 bytes each at most) that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles that one task counts.
PACKED = 1_000_000
#: Keys of rows without an id start here.
NO_ID = 1 << 62
_U = np.uint64


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for steps that hold two texts a row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _key(id_: Column, text: Column) -> Column:
    return F.coalesce(id_.cast("long"), F.xxhash64(text).bitwiseAND(NO_ID - 1) + F.lit(NO_ID))


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def run_length(similarity: float, k: int = K) -> int:
    """Neighbours in the runs that key the lists."""
    for length in (3, 2, 1):
        # chance of each number of common values at the end of a sequence without a whole run
        state = [1.0] + [0.0] * (length - 1)
        for _ in range(k):
            state = [sum(state) * (1 - similarity), *(x * similarity for x in state[:-1])]
        if sum(state) <= MISSED:
            return length
    raise ValueError(f"sketches of {k} values don't find pairs of similarity {similarity}; use more")


def whole_set_lengths(similarity: float, length: int, n: int) -> list[int]:
    """Shorter runs that a whole set of ``n`` values needs besides those of ``length``.

    A union of u values has at least s * u common ones in at most (1 - s) * u + 1
    stretches, so one of ``length`` if s * u > (length - 1) * ((1 - s) * u + 1).
    """
    out = []
    while length > 1 and n * (similarity - (length - 1) * (1 - similarity)) <= length - 1 + 1e-9:
        length -= 1
        out.append(length)
    return [x for x in out if x > 1 or n > 1]


def run_keys(sketch: np.ndarray, length: int = 3, similarity: float = 0.8, whole: bool = True) -> np.ndarray:
    """Keys of the runs of ``length`` neighbours in a sketch, and of the shorter ones that a whole set needs."""
    v = sketch.astype(_U)
    step = _U(shingles._STEP)
    wanted = [length, *(whole_set_lengths(similarity, length, len(v)) if whole else [])]
    out, run = [], v
    for n in range(1, length + 1):
        if n > 1:
            run = shingles.mix(run[:-1] * step + v[n - 1 :]) if len(v) >= n else v[:0]
        if n in wanted:
            out.append(run + _U(n))
    return np.concatenate(out).astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sketched(rows: DataFrame, words: int, k: int, similarity: float) -> DataFrame:
    length = run_length(similarity, k)

    def sketch(batches):
        for batch in batches:
            n, sig, keys = [], [], []
            for s in shingles.sets(batch.column("text"), words, SEPARATORS):
                n.append(len(s))
                sig.append(shingles.signature(s))
                keys.append(run_keys(s[:k], length, similarity, len(s) <= k))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), _lists(keys)], ["id", "key", "n", "sig", "keys"])

    return rows.mapInArrow(sketch, "id long, key long, n long, sig binary, keys array<long>")


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, text) of the documents whose keys are in ``ids``, a written table."""
    return rows.select(F.col("key").alias("cid"), "text").join(_few(ids), "cid")


def estimate(a: np.ndarray, b: np.ndarray, k: int, t: float) -> tuple[float, float]:
    """Similarity of two sets by the union of their sketches of k, and its standard deviation at similarity ``t``."""
    union = np.union1d(a[:k], b[:k])[:k]
    common = np.intersect1d(a[:k], b[:k], assume_unique=True)
    shared = int(np.searchsorted(common, union[-1], "right")) if len(union) else 0
    most = len(a) + len(b)
    spread = 0.0 if most <= k else (t * (1 - t) / len(union)) ** 0.5
    return shared / max(1, len(union)), spread


def _verified(pairs: DataFrame, rows: DataFrame, words: int, t: Fraction, scratch: Scratch, name: str, k: int) -> DataFrame:
    """Pairs (a, b) whose full sets have similarity t, from the texts; pairs that the estimate rules out aren't compared."""

    def compare(batches):
        for batch in batches:
            firsts = batch.column("a").to_pylist()
            fresh = [i for i, x in enumerate(firsts) if i == 0 or x != firsts[i - 1] or batch.column("ta")[i] != batch.column("ta")[i - 1]]
            own = shingles.sets(batch.column("ta").take(pa.array(fresh, pa.int64())), words, SEPARATORS)
            starts, s, linked = set(fresh), None, []
            for i, other in enumerate(shingles.sets(batch.column("tb"), words, SEPARATORS)):
                if i in starts:
                    s = next(own)
                guess, spread = estimate(s, other, k, float(t))
                if not len(s) or not len(other) or guess < float(t) - SPREAD * spread - 1e-9:
                    continue
                both = len(np.intersect1d(s, other, assume_unique=True))
                if both * t.denominator >= (len(s) + len(other) - both) * t.numerator:
                    linked.append(i)
            if linked:
                yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    pairs = scratch.table(pairs, f"{name}-pairs")
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), f"{name}-ids")
    with _batches_of(rows.sparkSession, 500):
        full = _texts(rows, ids)
        b = pairs.join(full.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
        both = b.join(full.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        return scratch.table(both.mapInArrow(compare, "a long, b long").distinct(), f"{name}-links")


def _listed(texts: DataFrame, words: int, t: Fraction, often: DataFrame) -> DataFrame:
    """(cid, n, alone, s): how many of a document's shingles stand in no other, and those of its prefix that do, the rarest first.

    ``often`` has packed (v, df) of the shingles of several documents, few enough
    to be sent to every task.
    """
    found = often.select("v", "df").toArrow()
    v, df = (np.concatenate([np.empty(0, np.int64), found.column(c).combine_chunks().flatten().to_numpy()]) for c in ("v", "df"))
    order = np.argsort(v)
    known = texts.sparkSession.sparkContext.broadcast((v[order], df[order]))

    def cut(batches):
        v, df = known.value
        for batch in batches:
            n, alone, kept = [], [], []
            for s in shingles.sets(batch.column("text"), words, SEPARATORS):
                at = np.searchsorted(v, s)
                found = at[at < len(v)]
                found = found[v[found] == s[: len(found)]]  # both are sorted
                n.append(len(s))
                alone.append(len(s) - len(found))
                size = len(s) - -(-len(s) * t.numerator // t.denominator) + 1
                kept.append(v[found[np.argsort(df[found], kind="stable")][: max(0, size - alone[-1])]])
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(n, pa.int64()), pa.array(alone, pa.int64()), _lists(kept)], ["cid", "n", "alone", "s"])

    return texts.mapInArrow(cut, "cid long, n long, alone long, s array<long>")


def _listed_by_joins(texts: DataFrame, words: int, t: Fraction, often: DataFrame) -> DataFrame:
    """The same for any number of shingles."""

    def tokens(batches):
        for batch in batches:
            s = list(shingles.sets(batch.column("text"), words, SEPARATORS))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([len(x) for x in s], pa.int64()), _lists(s)], ["cid", "n", "s"])

    token = texts.mapInArrow(tokens, "cid long, n long, s array<long>").select("cid", "n", F.explode("s").alias("v")).distinct()
    often = often.select(F.explode(F.arrays_zip("v", "df")).alias("x")).select("x.v", "x.df")
    ordered = token.join(often, "v").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
    alone = F.col("n") - F.size("s")
    prefix = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator - 1e-9) + 1
    cut = F.slice("s", 1, F.greatest(prefix - alone, F.lit(0)).cast("int"))
    return ordered.select("cid", "n", alone.alias("alone"), F.transform(cut, lambda x: x["v"]).alias("s"))


def _exact_candidates(members: DataFrame, rows: DataFrame, words: int, t: Fraction, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) among members (cid, n, least) of different components that prefixes, positions and sizes leave possible."""

    parts = max(8, -(-(members.agg(F.sum("n")).first()[0] or 0) // PACKED))

    def pack(part: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        own, first = np.unique(part[order], return_index=True)
        bounds = pa.array([*first, len(v)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(own), *(pa.ListArray.from_arrays(bounds, pa.array(x[order].astype(np.int64))) for x in (v, n))], ["part", "v", "df"])

    def count(batches):
        for batch in batches:
            v, n = np.unique(np.concatenate([np.empty(0, np.int64), *shingles.sets(batch.column("text"), words, SEPARATORS)]), return_counts=True)
            if len(v):
                yield pack(v % parts, v, n)

    def add(group: pa.Table) -> pa.Table:
        each, n = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("v", "df"))
        v, at = np.unique(each, return_inverse=True)
        df = np.bincount(at, n, len(v)).astype(np.int64)
        v, df = v[df > 1], df[df > 1]
        out = pack(v % parts, v, df) if len(v) else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), *(pa.array([], pa.list_(pa.int64())) for _ in "vd")], ["part", "v", "df"])
        return pa.Table.from_batches([out])

    packed = "part long, v array<long>, df array<long>"
    texts = _texts(rows, members.select("cid"))
    often = scratch.table(texts.select("text").mapInArrow(count, packed).groupBy("part").applyInArrow(add, packed), "often")
    few = (often.agg(F.sum(F.size("v"))).first()[0] or 0) <= BROADCAST_ROWS
    # what stands in one document only comes first, and isn't listed
    listed = (_listed if few else _listed_by_joins)(texts, words, t, often)
    listed = listed.withColumn("first", F.slice("s", 1, FIRST))
    listed = listed.select("cid", "n", "first", "alone", F.posexplode("s").alias("i", "v"))
    entry = listed.select("cid", "n", "first", "v", (F.col("n") - F.col("alone") - F.col("i")).alias("rest")).join(members.select("cid", "least"), "cid")
    entry = scratch.table(entry, "prefix")
    x, y = entry.alias("x"), entry.alias("y")
    na, nb = F.col("x.n"), F.col("y.n")
    enough = F.least("x.rest", "y.rest") * (t.numerator + t.denominator) >= (na + nb) * t.numerator
    alike = F.least(na, nb) * t.denominator >= F.greatest(na, nb) * t.numerator
    # a pair meets by its rarest common shingle only, as far as the first ones tell
    once = F.coalesce(F.get(F.array_intersect("x.first", "y.first"), F.lit(0)) == F.col("x.v"), F.lit(True))
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.least") != F.col("y.least")) & alike & enough & once)
    return met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def _torn(entries: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries (k, cid, n, members, least) of the lists whose members lie in several components of ``links``."""
    stars = scratch.table(components(links, scratch, "one").withColumnRenamed("node", "cid"), "stars")
    member = scratch.table(entries.join(_few(stars), "cid", "left").withColumn("least", F.coalesce("least", "cid")), "member")
    torn = member.groupBy("k").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("k")
    return scratch.table(member.join(_few(scratch.table(torn, "torn")), "k"), "open")


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, k: int = K) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    ``component_id`` is the smallest id that links reach, the row's own
    included, and ``kept`` whether the row has that id.  Rows without words link
    with nothing.  A row with a null id is kept only if its group has no id at
    all.  Repeated rows are kept or not alike.
    """
    return _grouped(docs, id_, text, words, similarity, k).select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), "component_id", "kept")


def _grouped(docs: DataFrame, id_: str, text: str, words: int = 5, similarity: float = 0.8, k: int = K) -> DataFrame:
    """(id, key, n, component_id, kept) of every row."""
    t = Fraction(similarity).limit_denominator(1000)
    if not isinstance(docs.schema[id_].dataType, (IntegralType, NullType)):
        raise TypeError(f"column {id_} isn't of whole numbers")
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id_).cast("long").alias("id"), _key(F.col(id_), F.col(text)).alias("key"), F.col(text).alias("text"))
    sketched = scratch.table(_sketched(rows, words, k, float(t)), "sketched")
    reps = scratch.table(sketched.where("n > 0").groupBy("sig").agg(F.min("key").alias("cid"), F.first("n").alias("n"), F.first("keys").alias("keys")), "reps")

    entries = reps.select("cid", "n", F.explode("keys").alias("k"))
    lists = scratch.table(entries.groupBy("k").agg(F.count("*").alias("members")).where("members > 1"), "lists")
    shared = scratch.table(entries.join(_few(lists), "k"), "shared")
    heart = shared.groupBy("cid").agg(F.avg(F.ln("members")).alias("heart"))
    alike = lambda a, b: F.least(F.col(a), F.col(b)) * t.denominator >= F.greatest(F.col(a), F.col(b)) * t.numerator
    pivots = (
        shared.join(heart, "cid")
        .withColumn("h", F.xxhash64("cid"))
        .groupBy("k")
        .agg(F.max(F.struct("heart", "h", "cid", "n")).alias("p"), F.min(F.struct("h", "cid", "n")).alias("q"))
        .select("k", F.explode(F.array(F.struct("p.cid", "p.n"), F.struct("q.cid", "q.n"))).alias("pivot"))
    )
    met = shared.join(_few(scratch.table(pivots, "pivots")), "k").where((F.col("cid") != F.col("pivot.cid")) & alike("n", "pivot.n"))
    met = met.select(F.least("cid", "pivot.cid").alias("a"), F.greatest("cid", "pivot.cid").alias("b")).distinct()
    first = _verified(met, rows, words, t, scratch, "first", k)
    tested = docs.sparkSession.read.parquet(scratch.path("first-pairs"))
    open_ = _torn(shared, first, scratch)
    scratch.drop("shared", "member")
    short = open_.where(F.col("members") <= SHORT)
    x, y = short.alias("x"), short.alias("y")
    across = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.least") != F.col("y.least")) & alike("x.n", "y.n"))
    across = across.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    crowd = scratch.table(open_.where(F.col("members") > SHORT).select("cid", "n", "least").distinct(), "crowd")
    if not crowd.isEmpty():
        across = across.unionByName(_exact_candidates(crowd, rows, words, t, scratch)).distinct()
    second = _verified(across.join(tested, ["a", "b"], "left_anti"), rows, words, t, scratch, "second", k)
    linked = components(first.unionByName(second), scratch, "two")

    group = reps.select("sig", "cid").join(linked.withColumnRenamed("node", "cid"), "cid", "left").select("sig", F.coalesce("least", "cid").alias("group"))
    out = sketched.select("id", "key", "n", "sig").join(group, "sig", "left").withColumn("group", F.coalesce("group", "key"))
    component = F.when(F.col("group") < NO_ID, F.col("group"))
    return out.select(
        "id",
        "key",
        "n",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull(), F.lit(False)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id.

    Fates are those of ``near_duplicates``: rows that share an id stay or go
    together, and so do rows without an id that share their text.
    """
    found = _grouped(docs, id_, text, **options)
    (key,) = unused(docs, "key")
    gone = Scratch(docs.sparkSession, "gone").table(found.where(~F.col("kept")).select(F.col("key").alias(key)).distinct(), "keys")
    return docs.withColumn(key, _key(F.col(id_), F.col(text))).join(_few(gone), key, "left_anti").select(*docs.columns)
