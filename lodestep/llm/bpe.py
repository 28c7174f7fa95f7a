"""Byte-level BPE encoding and decoding.

Text is split by the pre-token pattern and every pre-token is merged on its
own.  A segment tree over the byte positions of a pre-token holds, for every
live position, the rank of the pair that starts there; its root is the leftmost
pair of least rank.  A merge kills the right-hand position and makes three
point updates (the merged position, its left neighbour, the dead one), each of
them one path to the root.

Pre-tokens that a worker meets for the first time are merged together: those of
like length share one array of trees, so that each step is a few array
operations for thousands of trees.  Pre-tokens of more than ``WIDE`` bytes stand
side by side in one tree of ``FAN`` children a node, some ``LONG_BYTES`` at once;
a step takes all pairs of the least rank from left to right, as far as no merge
among them makes a pair that would go before the next.  They aren't remembered.

Null and empty text gives no ids and decodes to no bytes; an empty table gives an
empty one; repeated rows are coded each.  Every pre-token of a text is coded,
however long text and pre-token are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .session import ensure_importable

#: Largest rank file, as it is broadcast; some hundred thousand tokens.
RANK_BYTES = 16 << 20
#: Longest pre-token, in bytes, that is merged in an array of trees.
WIDE = 64
#: Pre-tokens of a generation that a worker remembers; it keeps two, and a word that is met again moves to the newer one.
REMEMBERED = 120_000
#: Pre-tokens of texts that are encoded together, and their characters; and bytes of trees that are merged at once.
TOGETHER, CHARACTERS, TREE_BYTES = 60_000, 1 << 22, 1 << 18
#: Bytes of long pre-tokens that share a tree, and below which each has one of its own; and children of a node of the shared tree.
LONG_BYTES, FEW_BYTES, FAN = 1 << 22, 1 << 14, 16

_NO_PAIR = np.int64(1) << 62
#: Above every key of a tree that is one of many: rank * WIDE + position must stay below.
_NONE = np.int32(2**31 - 1)


# Fixed value: the pre-token pattern that the standard library's matcher can take over.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
KNOWN_PATTERN = "|".join(f"'{c}" for c in _CONTRACTIONS) + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _narrow(top: int) -> str:
    """``KNOWN_PATTERN`` for text of code points below ``top``.

    Classes become plain ranges, which the standard library's matcher looks up
    in a table.  Branches that begin with different characters commute: words,
    the most frequent, are tried first and the contractions share their quote.
    """

    def ranges(kind: str) -> str:
        inside = [i for i in range(top) if regex.match(kind, chr(i))]
        ends = [i for i in inside if i + 1 not in inside]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip([i for i in inside if i - 1 not in inside], ends))

    letter, digit, space = (ranges(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return f" ?[{letter}]+|'(?:{'|'.join(_CONTRACTIONS)})| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"


class Splitter:
    """Cuts texts into the pre-tokens of a pattern."""

    def __init__(self, pattern: str):
        found = regex.compile(pattern)
        # a whole match is a pre-token, whatever groups the pattern has
        self.split_any = found.findall if not found.groups else lambda text: [m.group() for m in found.finditer(text)]
        self.narrow = [re.compile(_narrow(top)).findall for top in (0x80, 0x100)] if pattern == KNOWN_PATTERN else None

    def split(self, text: str) -> list[str]:
        if self.narrow is None:
            return self.split_any(text)
        if text.isascii():
            return self.narrow[0](text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.narrow[1](text)


class Codec:
    """Encoder and decoder for one vocabulary, given as the lines of its rank file, and one pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.split = Splitter(pattern).split
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted(
            (self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        )
        self.pair_key = np.array([k for k, _ in pairs] + [_NO_PAIR], np.int64)
        self.pair_rank = np.array([r for _, r in pairs] + [0], np.int32)
        # tokens that are part of a pair of lesser rank than their own, on its left or right
        self.early = np.zeros(len(self.bytes_of), bool)
        for part in (self.pair_key[:-1] >> 32, self.pair_key[:-1] & 0xFFFFFFFF):
            self.early[part[self.pair_rank[:-1] < part]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
        """Tree keys of the pairs of ids that start at ``at``; ``_NONE`` for pairs outside the vocabulary."""
        pair = left << 32 | right
        found = np.searchsorted(self.pair_key, pair)
        return np.where(self.pair_key[found] == pair, self.pair_rank[found] * np.int32(leaves) + at, _NONE)

    def _merge_together(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Packed ids of words of 2 to ``leaves`` bytes; ``leaves`` is a power of two."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int32, n)
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        ids = self.byte_id[raw]
        position = np.arange(leaves, dtype=np.int32)
        tree = np.full((n, 2 * leaves), _NONE, np.int32)
        inside = position[None, 1:] < length[:, None]
        # rank * leaves + position: the least key is the leftmost pair of least rank
        tree[:, leaves:-1] = np.where(inside, self._key(ids[:, :-1], ids[:, 1:], position[:-1], leaves), _NONE)
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after = np.broadcast_to(position + 1, (n, leaves)).copy()
        before = np.broadcast_to(position - 1, (n, leaves)).copy()
        alive = position[None, :] < length[:, None]
        todo = np.flatnonzero(tree[:, 1] < _NONE)

        def put(row: np.ndarray, at: np.ndarray, key: np.ndarray | np.int32) -> None:
            node = at + leaves
            tree[row, node] = key
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while todo.size:
            best = tree[todo, 1]
            at, merged = best % leaves, best // leaves
            dead = after[todo, at]
            ids[todo, at] = merged
            alive[todo, dead] = False
            put(todo, dead, _NONE)
            follow = after[todo, dead]
            after[todo, at] = follow
            inner = follow < length[todo]
            key = np.full(todo.size, _NONE, np.int32)
            if inner.any():
                r, a, f = todo[inner], at[inner], follow[inner]
                before[r, f] = a
                key[inner] = self._key(ids[r, a], ids[r, f], a, leaves)
            put(todo, at, key)
            left = before[todo, at]
            has = left >= 0
            if has.any():
                r, a, f = todo[has], left[has], at[has]
                put(r, a, self._key(ids[r, a], ids[r, f], a, leaves))
            todo = todo[tree[todo, 1] < _NONE]
        packed = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_alone(self, word: bytes) -> bytes:
        """Packed ids of one word, by a segment tree of its own."""
        ranks, n = self.ranks, len(word)
        leaves = 1 << max(1, (n - 1).bit_length())
        none = leaves * (len(self.bytes_of) + 1)
        ends = list(range(1, n + 1))  # byte position after the token at a live position
        before = list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def key(at: int) -> int:
            end = ends[at]
            rank = ranks.get(word[at : ends[end]]) if end < n else None
            return none if rank is None else rank * leaves + at

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for at in range(n):
            tree[leaves + at] = key(at)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            at = tree[1] % leaves
            dead = ends[at]
            ends[at] = ends[dead]
            put(dead, none)
            if ends[at] < n:
                before[ends[at]] = at
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at : ends[at]]])
            at = ends[at]
        return np.array(out, "<u4").tobytes()

    def _ranks_at(self, at: np.ndarray, ids: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at live positions of the shared tree; ``_NONE`` at a word's end."""
        follow = after[at]
        inside = ~first[follow]
        pair = ids[at].astype(np.int64) << 32 | ids[np.where(inside, follow, 0)]
        found = np.searchsorted(self.pair_key, pair)
        return np.where(inside & (self.pair_key[found] == pair), self.pair_rank[found], _NONE)

    def merge_side_by_side(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words, all in one tree."""
        starts = np.cumsum([0, *map(len, words)])
        n = int(starts[-1])
        ids = self.byte_id.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        first = np.zeros(n + 1, bool)  # of a word, or the end of all
        first[starts] = True
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        step = TREE_BYTES
        tree = [np.concatenate([self._ranks_at(np.arange(i, min(i + step, n)), ids, after, first).astype(np.int32) for i in range(0, n, step)])]
        while len(tree) == 1 or len(tree[-1]) > 1:
            low = tree[-1]
            tree[-1] = np.concatenate([low, np.full(-len(low) % FAN, _NONE, np.int32)])
            tree.append(tree[-1].reshape(-1, FAN).min(axis=1))
        children = [level.reshape(-1, FAN) for level in tree[:-1]]
        while (rank := tree[-1][0]) < _NONE:
            at = np.zeros(1, np.int64)
            for level in reversed(children):
                node, child = np.nonzero(level[at] == rank)
                at = at[node] * FAN + child
            # of pairs that overlap, each other one from the left
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            dead = after[at]
            follow = after[dead]
            if self.early[rank]:
                # what would go before the next merge, as neighbours stand when it is this one's turn: left ones are merged
                left = before[at]
                merged_left = np.concatenate([[False], dead[:-1] == left[1:]])
                left_id = np.where(merged_left, rank, ids[left])
                own = np.full(len(at), rank)
                sooner = ~first[follow] & (self._rank_of(own, ids[np.minimum(follow, n - 1)]) < rank)
                sooner |= ~first[at] & (self._rank_of(left_id, own) < rank)
                word = np.searchsorted(starts, at, "right")
                stop = np.full(len(words) + 1, n, np.int64)
                np.minimum.at(stop, word[sooner], at[sooner])
                keep = at <= stop[word]
                at, dead, follow = at[keep], dead[keep], follow[keep]
            ids[at], after[at], alive[dead] = rank, follow, False
            inner = ~first[follow]
            before[follow[inner]] = at[inner]
            changed = np.concatenate([at, before[at[~first[at]]]])
            tree[0][dead] = _NONE
            tree[0][changed] = self._ranks_at(changed, ids, after, first)
            nodes = np.unique(np.concatenate([changed, dead]) // FAN)
            for level, above in zip(children, tree[1:]):
                above[nodes] = level[nodes].min(axis=1)
                nodes = nodes // FAN
                nodes = nodes[np.concatenate([[True], nodes[1:] != nodes[:-1]])]
        packed, live = ids[alive].astype("<u4").tobytes(), np.flatnonzero(alive)
        ends = (np.searchsorted(live, starts) * 4).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        found = np.searchsorted(self.pair_key, pair)
        return np.where(self.pair_key[found] == pair, self.pair_rank[found], _NONE)

    def _merge_long(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        part: list[bytes] = []
        size = 0
        for i, word in enumerate(words):
            part.append(word)
            size += len(word)
            if size >= LONG_BYTES or i == len(words) - 1:
                out += [self.merge_alone(w) for w in part] if size < FEW_BYTES else self.merge_side_by_side(part)
                part, size = [], 0
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Remember the ids of words; those of long ones are returned instead."""
        wide: dict[int, list[tuple[str, bytes]]] = {}
        long: list[tuple[str, bytes]] = []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[word] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                long.append((word, raw))
            else:
                wide.setdefault(1 << (len(raw) - 1).bit_length(), []).append((word, raw))
        for leaves, group in wide.items():
            trees = max(1, TREE_BYTES // leaves)
            for i in range(0, len(group), trees):
                part = group[i : i + trees]
                self.known.update(zip((w for w, _ in part), self._merge_together([r for _, r in part], leaves)))
        return dict(zip((w for w, _ in long), self._merge_long([r for _, r in long])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        part: list[list[str]] = []
        size = characters = 0
        for i, text in enumerate(texts):
            part.append(self.split(text))
            size += len(part[-1])
            characters += len(text)
            if size >= TOGETHER or characters >= CHARACTERS or i == len(texts) - 1:
                # by lookups in the dictionary; with its keys as a set each difference would walk all of them
                new = set().union(*part).difference(self.known)
                for word in [w for w in new if w in self.older]:
                    self.known[word] = self.older[word]
                long = self.learn(new.difference(self.known))
                self.known.update(long)
                out += [b"".join(map(self.known.__getitem__, words)) for words in part]
                for word in long:
                    del self.known[word]
                if len(self.known) > REMEMBERED:
                    self.known, self.older = {}, self.known
                part, size, characters = [], 0, 0
        return out

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The lines of a rank file: of the driver, or under any address that Spark reads; at most ``RANK_BYTES``."""
    if "://" in path:
        found = spark.read.format("binaryFile").load(path).where(F.col("length") <= RANK_BYTES).select("content").first()
        ranks = bytes(found.content) if found else None
    else:
        ranks = Path(path).read_bytes() if Path(path).stat().st_size <= RANK_BYTES else None
    if ranks is None:
        raise ValueError(f"{path} is larger than {RANK_BYTES} bytes")
    return ranks


_held: dict[tuple[str, str], Codec] = {}


def _kept(name: tuple[str, str], sent: Broadcast) -> Codec:
    """The worker's codec of a (digest of the ranks, pattern)."""
    if name not in _held:
        _held.clear()
        _held[name] = Codec(sent.value, name[1])
    return _held[name]


def codec(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], Codec]:
    """What gives a worker its codec, which is built once and kept for later tasks.

    The driver reads the rank file and broadcasts it, so that workers need no
    file of that path.
    """
    ranks = read_ranks(spark, ranks_path)
    name, sent = (hashlib.sha256(ranks).hexdigest(), pattern), spark.sparkContext.broadcast(ranks)
    return lambda: _kept(name, sent)


def encode_column(text: Column, own: Callable[[], Codec]) -> Column:
    """Packed ids (binary, little-endian unsigned 32-bit) of a text column."""

    @F.pandas_udf(BinaryType())
    def encode_text(s: pd.Series) -> pd.Series:
        return pd.Series(own().encode(s.fillna("").tolist()), dtype=object)

    return encode_text(text)


def decode_column(packed: Column, own: Callable[[], Codec]) -> Column:
    """Bytes of a column of packed ids."""

    @F.pandas_udf(BinaryType())
    def decode_ids(s: pd.Series) -> pd.Series:
        return s.map(own().decode, na_action="ignore")

    return decode_ids(packed)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add column ``out`` with the packed ids of column ``text``; an existing ``out`` is replaced."""
    ensure_importable(df.sparkSession)
    return df.withColumn(out, encode_column(df[text], codec(df.sparkSession, ranks_path, pattern)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add column ``out`` with the bytes that packed ids stand for; null ids give null."""
    ensure_importable(df.sparkSession)
    return df.withColumn(out, decode_column(df[ids], codec(df.sparkSession, ranks_path, pattern)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", intact: str | None = None) -> DataFrame:
    """Add the packed ids of a text, the bytes that they decode to, and whether these are the text's; columns of those names are replaced.

    The same as ``encode`` and then ``decode``, but each text is encoded once and
    crosses to Python once.  Without ``decoded`` its bytes, as large as the
    text, stay in the worker.
    """
    ensure_importable(df.sparkSession)
    back, codec_of = decoded is not None, codec(df.sparkSession, ranks_path, pattern)

    @F.pandas_udf("struct<ids:binary,decoded:binary,intact:boolean>")
    def both_ways(s: pd.Series) -> pd.DataFrame:
        own = codec_of()
        texts = s.fillna("").tolist()
        packed = own.encode(texts)
        plain, same = [], []
        for t, p in zip(texts, packed):
            bytes_ = own.decode(p)
            same.append(bytes_ == t.encode("utf-8", "surrogatepass"))
            plain.append(bytes_ if back else None)
        return pd.DataFrame({"ids": pd.Series(packed, dtype=object), "decoded": pd.Series(plain, dtype=object), "intact": pd.Series(same, dtype=bool)})

    coded = both_ways(df[text])
    new = {ids: coded["ids"]} | ({decoded: coded["decoded"]} if back else {}) | ({intact: coded["intact"]} if intact else {})
    return df.withColumns(new)
