"""Benchmark decontamination with DataFrame operations only.

Words are the runs of letters and digits after A-Z is lower-cased.  A benchmark
item gives windows of ``size`` consecutive words; an item of fewer words, but
not none, is one window.  A document word inside any occurrence of a window is
hit.

Documents aren't cut into windows at every word.  A window of n words always
holds, whole, one of the document's consecutive groups of q = (n + 1) // 2
words.  So a document is cut into its groups, which are looked up in the hash
set of all q-word runs of the benchmark's windows, and only where a group is
found the n-word windows around it are made and compared, as strings, with the
benchmark's.  Each window belongs to the first group that starts inside it, so
none is made twice.

The hash sets are broadcast while the benchmark has at most ``broadcast_words``
words, else they are joined by a shuffle.  Items of few words give windows, and
so groups, of other lengths; the groups of all lengths come from one pass over
the documents.  Hits are found per text, by digest, and are broadcast to the
documents while they take at most ``HIT_BYTES``, so that documents aren't
shuffled and a digest that many share is no hot key; beyond, Spark's skew
handling of the join spreads it.

Null and empty texts have no words and no hits; null items and items without
words have no windows; repeated item ids count once; a null item id has no name
and isn't listed, though its windows hit.  Without documents or without items
nothing is hit.  Repeated rows are marked, or removed, alike.  Whole texts are
looked up, however long.  Columns keep their values whatever their names, but for
those that a function says it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Scratch, unused

# What lies between words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 10
#: Benchmark words up to which its hash sets are broadcast: some 100 bytes for each.
BROADCAST_WORDS = 1_000_000
#: Digests of texts to be removed (16 bytes each) that are broadcast; beyond, texts are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000
#: Bytes of hits (spans and item names by text) that are broadcast.
HIT_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """A text's words with one space between; null gives the empty string."""
    # lower() also folds letters beyond ASCII, so it serves only texts that have none
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(""))


def word_count(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) + 1).cast("long")


def _groups(norm: Column, q: int) -> Column:
    """Consecutive groups of ``q`` words; the last has those that are left."""
    return F.regexp_extract_all(norm, F.lit(rf"[^ ]++(?: [^ ]++){{0,{q - 1}}}+"), 0)


def _run(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def _runs(words: Column, size: Column, n: Column | int) -> Column:
    """All runs of ``n`` of the words, of which there are ``size``."""
    return F.transform(F.sequence(F.lit(0), size - n), lambda i: _run(words, i, n))


def windows(benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """Distinct (item, n, run): the windows of a benchmark and their numbers of words."""
    words = F.split(F.col("norm"), " ")
    n = F.least(F.size("words"), F.lit(size))
    return (
        benchmark.select(F.col(item).alias("item"), normalised(F.col(text)).alias("norm"))
        .where("norm <> ''")
        .withColumn("words", words)
        .select("item", n.alias("n"), F.explode(_runs(F.col("words"), F.size("words"), n)).alias("run"))
        .distinct()
    )


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Where windows occur: (digest, n_words, item, start, n), starts in words from 0, by the digest of the normalised text."""
    bench = windows(benchmark, size, item, item_text)
    lengths = {r.n: r.c for r in bench.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most ``size`` rows
    small = sum(lengths.values()) <= broadcast_words
    side = F.broadcast if small else lambda df: df
    # no filter on computed columns here: it would be pushed down and normalise each text once more
    base = docs.select(normalised(F.col(text)).alias("norm")).select(F.unhex(F.md5("norm")).alias("digest"), word_count(F.col("norm")).alias("n_words"), "norm")
    if not lengths:
        return base.where("false").select("digest", "n_words", F.lit(None).cast(benchmark.schema[item].dataType).alias("item"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    half = F.floor((F.col("n") + 1) / 2).cast("int")
    words = F.split("run", " ")
    grams = bench.select("n", half.alias("q"), F.explode(_runs(words, F.size(words), half)).alias("gram")).groupBy("q", "gram").agg(F.collect_set("n").alias("ns"))
    cuts = F.array(*(F.struct(F.lit(q).alias("q"), _groups(F.col("norm"), q).alias("groups")) for q in sorted({(n + 1) // 2 for n in lengths})))
    found = (
        base.select("digest", "n_words", F.explode(cuts).alias("cut"))
        .select("digest", "n_words", "cut.q", "cut.groups")
        .select("digest", "n_words", "q", "groups", F.posexplode_outer("groups").alias("g", "gram"))
        .join(side(grams), ["q", "gram"])
        .select("digest", "n_words", "q", "groups", "g", F.explode("ns").alias("n"))
    )
    # the windows whose first whole group is g: they start at most q - 1 words before it
    q, g, n = F.col("q"), F.col("g"), F.col("n")
    first = F.greatest(g * q - (q - 1), F.lit(0))
    last = F.least(g * q, F.col("n_words").cast("int") - n)
    around = F.split(F.array_join(F.slice("groups", F.greatest(g, F.lit(1)), F.when(g == 0, 2).otherwise(3)), " "), " ")
    tried = (
        found.where(last >= first)
        .select("digest", "n_words", "n", F.greatest((g - 1) * q, F.lit(0)).alias("base"), around.alias("around"), F.explode(F.sequence(first, last)).alias("start"))
        .select("digest", "n_words", "n", "start", _run(F.col("around"), F.col("start") - F.col("base"), F.col("n")).alias("run"))
    )
    return tried.join(side(bench), ["n", "run"]).select("digest", "n_words", "item", "start", "n")


def _covered(spans: Column) -> Column:
    """Words covered by sorted (start, end) spans."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        state,
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")),
        lambda s: s["n"],
    )


ADDED = ("n_words", "n_hit", "hit_items", "hit_spans")


def _marked(docs: DataFrame, benchmark: DataFrame, names: list[str], size: int, text: str, item: str, item_text: str) -> DataFrame:
    """``docs`` with what ``contamination`` adds, as columns ``names``, none of which ``docs`` has."""
    n_words, n_hit, hit_items, hit_spans = names
    digest, norm = unused(docs.withColumns({n: F.lit(None) for n in names}), "digest", "norm")
    # the hits of one text are bounded by its length and the benchmark's items
    per_text = (
        occurrences(docs, benchmark, size, text, item, item_text)
        .groupBy(F.col("digest").alias(digest))
        .agg(
            F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias(hit_spans),
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias(hit_items),
        )
    )
    per_text = Scratch(docs.sparkSession, "hits").table(per_text, "texts")
    weight = F.lit(64) + 8 * F.size(hit_spans) + 16 * F.size(hit_items) + F.length(F.array_join(hit_items, ""))
    if (per_text.agg(F.sum(weight)).first()[0] or 0) <= HIT_BYTES:
        per_text = F.broadcast(per_text)
    keyed = docs.withColumn(norm, normalised(F.col(text))).withColumns({digest: F.unhex(F.md5(norm)), n_words: word_count(F.col(norm))}).drop(norm)
    return (
        keyed.join(per_text, digest, "left")
        .withColumns({n_hit: F.coalesce(_covered(F.col(hit_spans)), F.lit(0)).cast("long"), hit_items: F.coalesce(hit_items, F.array().cast("array<string>"))})
        .select(*docs.columns, *names)
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (item ids sorted as strings) and hit_spans ((start, end) in words, sorted; null without hits).

    One row per row of ``docs``; columns of those names are replaced.  The hits
    are computed, and written, when this is called.
    """
    names = unused(docs, *ADDED)
    found = _marked(docs, benchmark, names, size, text, item, item_text)
    return found.select(*(c for c in docs.columns if c.lower() not in ADDED), *(F.col(n).alias(a) for n, a in zip(names, ADDED)))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    text = options.get("text", "text")
    (digest,) = unused(docs, "digest")
    hit = occurrences(docs, benchmark, **options).select(F.col("digest").alias(digest)).distinct()
    hit = Scratch(docs.sparkSession, "hits").table(hit, "digests")
    if hit.count() <= BROADCAST_DIGESTS:  # so the texts stay where they are
        hit = F.broadcast(hit)
    keyed = docs.withColumn(digest, F.unhex(F.md5(normalised(F.col(text)))))
    return keyed.join(hit, digest, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", mark: str = " ", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with every hit word, and what stands between hit neighbours, replaced by ``mark``; texts without hits stay as they are."""
    names = unused(docs, *ADDED)
    found = _marked(docs, benchmark, names, size, text, item, item_text)
    words, gaps = unused(found, "words", "gaps")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
    inside = lambda i: F.exists(names[3], lambda s: (s["start"] <= i) & (i < s["end"]))
    kept = F.transform(
        words,
        lambda w, i: F.concat(
            F.when(inside(i), F.when(inside(i + 1), F.lit("")).otherwise(F.lit(mark))).otherwise(w),
            F.when(inside(i) & inside(i + 1), F.lit("")).otherwise(F.element_at(gaps, i + 2)),
        ),
    )
    cut = found.withColumns({words: F.regexp_extract_all(F.col(text), F.lit(word), 0), gaps: F.split(F.col(text), word)})
    rebuilt = F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))
    return cut.withColumn(text, F.when(F.col(names[1]) > 0, rebuilt).otherwise(F.col(text))).select(*docs.columns)
