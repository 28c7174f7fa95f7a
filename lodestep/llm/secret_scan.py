"""Secret scan: patterned secrets and high-entropy strings, as spans of a text.

Patterned spans are those of ``PATTERNS``, each found leftmost and without
overlap of its own kind.  Kind ``entropy`` is added by the method: candidate
strings are cut into runs of one character class, a window slides along each
run, and its Shannon entropy follows from character counts that are updated by
one character in and one out.  Windows at or above the class's threshold are
joined to spans.  A span is suppressed if the allow list matches it or the value
that holds it (the whole candidate string, or what stands between its ``=``), or
if a patterned span covers it already.  Keys of fewer than ``WINDOW`` characters
have no window and are found only by a pattern.  The time is linear in the text.

Starts and ends are code points, ends exclusive.  Null and empty texts have no
spans; an empty table gives an empty one; repeated rows get the same spans each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ensure_importable

# Kinds, their patterns, the group that has a least length, and that length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "entropy")
SCHEMA = "array<struct<kind:string,start:int,end:int>>"


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars``; a window counts if its entropy reaches ``bits`` and it has so many characters of each of ``needs``."""

    chars: str
    bits: float
    needs: tuple[tuple[str, int], ...]


CLASSES = (
    CharClass("0-9a-fA-F", 3.0, ((_DIGITS, 1), ("abcdefABCDEF", 1))),
    CharClass("A-Za-z0-9+/_-", 3.9, ((_DIGITS, 1), (_LOWER, 1), (_UPPER, 1))),
    CharClass("a-z0-9", 3.7, ((_DIGITS, 3), (_LOWER, 3))),
    CharClass("A-Z0-9", 3.7, ((_DIGITS, 3), (_UPPER, 3))),
)
_STANDS_FOR = "(?:example|placeholder|changeme|dummy|sample)"
#: Sequences that somebody types, or that name an alphabet.
_SEQUENCES = (_DIGITS, _DIGITS + "abcdef", _LOWER, _DIGITS + _LOWER, _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS, _DIGITS + _UPPER + _LOWER, _DIGITS + _LOWER + _UPPER)


def _mostly(sequence: str) -> str:
    """A string of which the sequence, or its first ten characters, is half or more."""
    return "|".join(f".{{0,{n // 2}}}{sequence[:n]}.{{0,{n // 2}}}" for n in sorted({10, len(sequence)}))


#: Strings that look random and are no secrets.  What marks a dummy must stand at an end of a string, or alone between
#: separators, or be most of it, so that a long key isn't the likelier to be passed over.
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    rf"(?is:{_STANDS_FOR}.*|.*{_STANDS_FOR}(?:key|token|secret|value)?|.*[^a-z0-9]{_STANDS_FOR}[^a-z0-9].*)",
    f"(?i:{'|'.join(map(_mostly, _SEQUENCES))})",
)
WINDOW = 20


class Scanner:
    """Finds the spans of texts."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, window: int = WINDOW):
        self.window = window
        self.classes = [(re.compile(f"[{c.chars}]{{{window},}}"), c) for c in classes]
        self.allow = [re.compile(a) for a in allow]
        self.candidate = re.compile(f"[A-Za-z0-9+/_=-]{{{window},}}")
        self.weight = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]  # n log2 n

    def patterned(self, text: str) -> list[tuple[int, int, int]]:
        """(start, order of kind, end) of the patterned spans."""
        return [
            (m.start(), order, m.end())
            for order, (_, pattern, group, least) in enumerate(PATTERNS)
            for m in pattern.finditer(text)
            if m.end(group) - m.start(group) >= least
        ]

    def windows(self, run: str, kind: CharClass) -> list[tuple[int, int]]:
        """Joined windows of a run that reach the class's entropy and have what it needs."""
        w, weight = self.window, self.weight
        counts: dict[str, int] = {}
        have = [0] * len(kind.needs)
        total, out = 0.0, []
        most = w * (math.log2(w) - kind.bits) + 1e-9  # entropy >= bits iff total <= most
        for i, ch in enumerate(run):
            if i >= w:  # the old one leaves first, so that no count exceeds the window
                old = run[i - w]
                n = counts[old]
                counts[old] = n - 1
                total += weight[n - 1] - weight[n]
                for k, (need, _) in enumerate(kind.needs):
                    have[k] -= old in need
            n = counts.get(ch, 0)
            counts[ch] = n + 1
            total += weight[n + 1] - weight[n]
            for k, (need, _) in enumerate(kind.needs):
                have[k] += ch in need
            if i >= w - 1 and total <= most and all(h >= least for h, (_, least) in zip(have, kind.needs)):
                if out and out[-1][1] >= i + 1 - w:
                    out[-1][1] = i + 1
                else:
                    out.append([i + 1 - w, i + 1])
        return [tuple(x) for x in out]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = self.patterned(text)
        covers = sorted((s, e) for s, _, e in found)
        k = reach = 0
        for m in self.candidate.finditer(text):
            string, base = m.group(), m.start()
            value, spared = None, False
            for a, b in self.high(string):
                while k < len(covers) and covers[k][0] <= base + a:
                    reach = max(reach, covers[k][1])
                    k += 1
                if reach >= base + b:
                    continue
                start = string.rfind("=", 0, a) + 1
                if value != start:
                    end = string.find("=", b)
                    value, spared = start, self.allowed(string[start : end if end >= 0 else len(string)])
                if not spared and not self.allowed(string[a:b]):
                    found.append((base + a, len(KINDS) - 1, base + b))
        return [(KINDS[k], s, e) for s, k, e in sorted(found)]

    def high(self, string: str) -> list[tuple[int, int]]:
        """Joined windows of all classes in a candidate string."""
        added = [(run.start() + a, run.start() + b) for runs, kind in self.classes for run in runs.finditer(string) for a, b in self.windows(run.group(), kind)]
        joined: list[list[int]] = []
        for a, b in sorted(added):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        return [(a, b) for a, b in joined]

    def allowed(self, string: str) -> bool:
        return any(p.fullmatch(string) for p in self.allow)


def spans_column(text: Column, scanner: Scanner | None = None) -> Column:
    """The spans of a text column, by start and then kind."""
    scanner = scanner or Scanner()

    @F.pandas_udf(SCHEMA)
    def find(s: pd.Series) -> pd.Series:
        out = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t)] if t else [] for t in s.fillna("")]
        return pd.Series(out, index=s.index, dtype=object)

    return find(text)


def scan(df: DataFrame, text: str = "text", out: str = "spans", scanner: Scanner | None = None) -> DataFrame:
    """Add column ``out``, an array of (kind, start, end); an existing ``out`` is replaced."""
    ensure_importable(df.sparkSession)
    return df.withColumn(out, spans_column(df[text], scanner))


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", scanner: Scanner | None = None) -> DataFrame:
    """Replace every span of column ``text`` by ``mark``; overlapping spans get one mark, null text stays null."""
    ensure_importable(df.sparkSession)
    scanner = scanner or Scanner()

    def clean(t: str) -> str:
        out, at = [], 0
        for _, a, b in scanner.spans(t):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def replace(s: pd.Series) -> pd.Series:
        return s.map(clean, na_action="ignore")

    return df.withColumn(text, replace(df[text]))
