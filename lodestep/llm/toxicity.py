"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Text is folded first: case, accents and compatibility forms, homoglyphs of
other scripts, and digits or signs that stand for letters.  Folding keeps one
character per character, so that matches point into the text.  ``i`` and ``l``
fold to one letter, as 1, ! and | stand for either.  Entries are whole words, or
stems (written with ``*``) at the start of a word.  A match inside an exception
phrase doesn't count, nor does one whose original has no letter.  The weights of
the matches, the longest at each place, divided by the square root of the text's
length in words, go through a logistic curve.

Lexicon, exceptions and curve are fitted on a bounded sample of labelled rows.
A stem becomes an entry only on the evidence of ``COMPLETIONS`` different words
of which none is most of it and no frequent one is harmless: one word's toxicity
says nothing about others that begin alike.  A pair of neighbouring words that
holds an entry becomes an exception if it stands in ``least`` clean rows and in
no toxic one.

Null and empty texts have no match and get the curve's value at 0; an empty
table gives an empty one; repeated rows get one score each; texts are matched
whole, however long.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Scratch, ensure_importable

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ß": "s", "œ": "o", "æ": "a",
}
SIGNS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: Phrases that hold a word of insult and are harmless, besides those that the fit learns.
EXCEPTIONS = ("clown fish", "circus clown", "trash can", "trash bag", "trash bin", "stupidly good", "loser bracket", "pond scum")

#: Bounds of the fit: labelled rows used, entries kept, and exceptions learnt.
FIT_ROWS, ENTRIES, LEARNT = 20_000, 4_000, 1_000
#: Letters of a stem, and different toxic words that must begin with it.
SHORTEST, LONGEST, COMPLETIONS = 4, 8, 5


class _Fold(dict):
    """Translation table that folds a character when it is first met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        base = SIGNS.get(ch)
        if base is None:
            base = unicodedata.normalize("NFKD", ch).lower()[:1] or " "
            base = HOMOGLYPHS.get(base, base)
            base = HOMOGLYPHS.get(base.lower(), base)
        if base == "l":
            base = "i"
        self[code] = base if base.isalpha() else " "
        return self[code]


_FOLD = _Fold()
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")


def fold(text: str) -> str:
    """Folded text: letters and spaces; marks that aren't seen are left out first."""
    return (text if text.isascii() else _INVISIBLE.sub("", text)).translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Folded entries with weights, a stem ending in ``*``; folded exception phrases; the curve's slope and offset."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -3.0


@functools.lru_cache(maxsize=4)
def _automaton(entries: tuple, exceptions: tuple) -> ahocorasick.Automaton | None:
    found: dict[str, list] = {}
    for entry, weight in entries:
        word = entry.removesuffix("*")
        found.setdefault(word, [len(word), None, None, False])[1 if word == entry else 2] = weight
    for phrase in exceptions:
        found.setdefault(phrase, [len(phrase), None, None, False])[3] = True
    words = ahocorasick.Automaton()
    for word, what in found.items():
        words.add_word(word, tuple(what))
    if not len(words):
        return None
    words.make_automaton()
    return words


def matches(text: str | None, lexicon: Lexicon) -> tuple[list[tuple[int, int, float]], str, str]:
    """(start, end, weight) of a text's matches in what is seen of it, that, and its folded form."""
    words = _automaton(lexicon.entries, lexicon.exceptions)
    seen = (text if text.isascii() else _INVISIBLE.sub("", text)) if text else ""
    folded = seen.translate(_FOLD)
    if not seen or words is None:
        return [], seen, folded
    best: dict[int, tuple[int, float]] = {}
    barred: list[tuple[int, int]] = []
    for last, (size, whole, stem, phrase) in words.iter(folded):
        start, end = last + 1 - size, last + 1
        if start and seen[start - 1].isalnum():
            continue
        ends = end == len(seen) or not seen[end].isalnum()
        weight = whole if ends and whole is not None else stem
        if weight is not None and end > best.get(start, (0, 0.0))[0]:
            best[start] = (end, weight)
        if phrase and ends:
            barred.append((start, end))
    out = []
    barred.sort()
    k = reach = 0
    for start, (end, weight) in sorted(best.items()):
        while k < len(barred) and barred[k][0] <= start:
            reach = max(reach, barred[k][1])
            k += 1
        if reach < end and any(c.isalpha() for c in seen[start:end]):
            out.append((start, end, weight))
    return out, seen, folded


def weigh(text: str | None, lexicon: Lexicon) -> tuple[float, int]:
    """Sum of the weights of a text's matches over the root of its length; and their number."""
    found, _, folded = matches(text, lexicon)
    return (sum(w for _, _, w in found) / math.sqrt(10 + len(folded.split())) if found else 0.0), len(found)


def _phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Folded pairs of neighbouring words of which one is a match."""
    found, _, folded = matches(text, lexicon)
    starts = {a for a, _, _ in found}
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", folded)] if found else []
    return {folded[a:d] for (a, b), (c, d) in zip(words, words[1:]) if (a in starts or c in starts) and c == b + 1}


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    exceptions: tuple[str, ...] = EXCEPTIONS,
    least: int = 5,
    entries: int = ENTRIES,
) -> Lexicon:
    """Learn a lexicon from labelled rows, whose number the caller bounds; equal texts count once.

    The rows are written once and read from there.  What comes to the driver are
    the counts of at most ``8 * entries`` features, of at most ``LEARNT``
    phrases, and one number per row.  Without rows of both labels the lexicon is
    empty.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where("label is not null and text is not null")
    rows = Scratch(labelled.sparkSession, "lexicon").table(rows.groupBy("text").agg((F.max("label") != 0).cast("int").alias("label")), "rows")

    def count(batches):
        for pdf in batches:
            tally: dict[str, list[int]] = {"": [0, 0]}
            for t, y in zip(pdf["text"], pdf["label"]):
                words = set(fold(t).split())
                for f in (*words, *{f"{w[:n]}*" for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}, ""):
                    tally.setdefault(f, [0, 0])[y] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in tally.items()], columns=["feature", "clean", "toxic"])

    counted = rows.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = Scratch(labelled.sparkSession, "lexicon").table(counted, "features")
    total = counted.where("feature = ''").first()
    if not total or not total.toxic or not total.clean:
        return Lexicon((), tuple(map(fold, exceptions)))
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.log((F.col("clean") + 0.5) / (total.clean + 1))
    weighed = counted.where("feature <> ''").withColumn("weight", odds)
    words = weighed.where("not feature like '%*' and length(feature) > 1")
    begins = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("feature"), F.lit(LONGEST))), lambda n: F.concat(F.substr("feature", F.lit(1), n), F.lit("*")))
    stems = (
        words.where(F.length("feature") >= SHORTEST)
        .select("toxic", "weight", F.explode(begins).alias("stem"), (F.col("toxic") + F.col("clean") >= 4 * least).alias("often"))
        .groupBy("stem")
        .agg(F.count_if(F.col("toxic") > 0).alias("completions"), F.max("toxic").alias("most"), F.sum("toxic").alias("sum"), F.min(F.when(F.col("often"), F.col("weight"))).alias("worst"))
        .where((F.col("completions") >= COMPLETIONS) & (2 * F.col("most") <= F.col("sum")) & (F.coalesce("worst", F.lit(0.0)) >= 0))
    )
    stems = weighed.join(stems, F.col("feature") == F.col("stem")).select(*weighed.columns)
    best = (
        words.unionByName(stems)
        .where((F.col("toxic") >= least) & (F.col("weight") >= 2.5))
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "feature")
        .limit(8 * entries)
        .collect()
    )
    weight = {r.feature: r.weight for r in best}
    kept: dict[str, float] = {}
    for f in sorted(weight, key=lambda f: (len(f.removesuffix("*")), f)):  # an extension says no more than a stem as sure as itself
        if not any(kept.get(f"{f[:n]}*", -9.0) >= weight[f] - 0.7 for n in range(SHORTEST, len(f.removesuffix("*")))):
            kept[f] = weight[f]
    chosen = tuple(sorted(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:entries]))
    draft = Lexicon(chosen, tuple(map(fold, exceptions)))

    def phrases(batches):
        for pdf in batches:
            tally: dict[str, list[int]] = {}
            for t, y in zip(pdf["text"], pdf["label"]):
                for phrase in _phrases(t, draft):
                    tally.setdefault(phrase, [0, 0])[y] += 1
            yield pd.DataFrame([(p, a, b) for p, (a, b) in tally.items()], columns=["phrase", "clean", "toxic"])

    told = rows.mapInPandas(phrases, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = told.where(f"toxic = 0 and clean >= {least}").orderBy(F.desc("clean"), "phrase").limit(LEARNT).collect()
    draft = Lexicon(chosen, (*draft.exceptions, *(r.phrase for r in harmless)))

    def weights(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [weigh(t, draft)[0] for t in pdf["text"]], "y": pdf["label"]})

    sample = rows.mapInPandas(weights, "x double, y int").toPandas().sort_values(["x", "y"])
    slope, offset = _logistic(sample["x"].to_numpy(), sample["y"].to_numpy())
    return Lexicon(chosen, draft.exceptions, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature, by Newton steps."""
    design = np.column_stack([x, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - ridge * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score", hits: str | None = None) -> DataFrame:
    """Add column ``out``, 0 to 1, and column ``hits``, the number of matches, if named."""
    ensure_importable(df.sparkSession)

    @F.pandas_udf("struct<score:double,hits:int>")
    def rate(s: pd.Series) -> pd.DataFrame:
        found = [weigh(t, lexicon) for t in s.fillna("")]
        x = np.array([f[0] for f in found], float)
        p = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -60, 60)))
        return pd.DataFrame({"score": p, "hits": np.array([f[1] for f in found], np.int32)})

    rated = rate(df[text])
    return df.withColumns({out: rated["score"]} | ({hits: rated["hits"]} if hits else {}))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, held_out=None) -> DataFrame:
    """At most ``rows`` labelled documents, taken by the hash of their id; ``held_out`` is a condition on labels to leave out.

    The ids are few by that bound and go to all executors; texts stay where they are.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        ids = ids.where(~held_out)
    ids = ids.select("doc_id", label).orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(rows).groupBy("doc_id").agg(F.max(label).alias(label))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
