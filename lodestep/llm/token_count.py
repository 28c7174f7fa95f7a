"""Token counts of whole texts, as a tokenizer's library gives them.

A text is cut into pre-tokens by the tokenizer's own pattern, and each worker
asks the library for the number of tokens of each pre-token that it meets for
the first time.  Texts of twice ``CHUNK`` characters or more are cut into chunks
that overlap; the chunks are spread over tasks, each is encoded with offsets,
and neighbours are spliced at a boundary that both have.

A boundary is proven if (1) both chunks have a pre-token boundary there, and (2)
in the left chunk a character that isn't white space stands at it or after it,
and so far from the chunk's end that no added token and no look-ahead of the
pattern that begins before it can reach the end.  By (2) the left chunk sees all
that decides its boundaries up to there, so it has those of the whole text.  The
pattern looks only forwards, so from a boundary of the whole text on the right
chunk has the whole text's pre-tokens.  Between two splices the tokens are thus
those of the whole text.  Where neighbours have no proven boundary in common,
the text is cut again into chunks and overlaps ``WIDEN`` times as long, at last
into one chunk.

The proof holds for byte-level BPE with the usual pattern and no normalizer.
Other tokenizers (``.json`` of other kinds, sentencepiece's ``.model``) get every
text whole.  Special strings in texts are handled as is the library's default;
none are added.

Null and empty texts have no tokens; repeated rows are counted each; an empty
table gives an empty one; ties don't arise.  Other columns stay.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .session import Scratch, ensure_importable, unused

#: Characters of a chunk before its overlap, characters of the overlap, and by how much both grow where chunks don't align.
CHUNK, OVERLAP, WIDEN = 8_192, 256, 4
#: Characters of pre-tokens that a worker remembers in each of two generations, and the longest that is remembered.
REMEMBERED, LONGEST = 4_000_000, 64
#: Pre-tokens of texts that are counted together.
TOGETHER = 60_000
#: Counts of texts (40 bytes each) up to which they are broadcast to the rows.
BROADCAST_ROWS = 500_000
#: Look-ahead of the pattern, in characters.
_AHEAD = 4


class Tokenizer:
    """Counts of one tokenizer, given as the bytes of its file."""

    def __init__(self, content: bytes, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.splits = False
        if kind == "model":
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.library = lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]
            return
        import tokenizers

        own = tokenizers.Tokenizer.from_buffer(content)
        own.no_truncation()
        own.no_padding()
        self.library = lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
        facts = json.loads(content)
        added = facts.get("added_tokens") or []
        before = facts.get("pre_tokenizer") or {}
        model = facts["model"]
        self.splits = (
            facts.get("normalizer") is None
            and (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) == ("ByteLevel", True, False)
            and model["type"] == "BPE"
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(a.get(x) for a in added for x in ("single_word", "lstrip", "rstrip"))
            and len(added) <= 1  # one token can't overlap another
        )
        self.added = [a["content"] for a in added]
        self.margin = _AHEAD + max(map(len, self.added), default=0)
        self.cut_added = re.compile(f"({'|'.join(map(re.escape, self.added))})").split if added else None
        self.pattern = bpe.Splitter(bpe.KNOWN_PATTERN)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; an added token is one."""
        if self.cut_added is None or self.added[0] not in text:
            return self.pattern.split(text)
        return [w for i, part in enumerate(self.cut_added(text)) for w in ([part] if i % 2 else self.pattern.split(part))]

    def _counts(self, part: list[list[str]]) -> list[np.ndarray]:
        """Tokens of each pre-token of some texts."""
        # by lookups in the dictionary; with its keys as a set each difference would walk all of them
        new = set().union(*part).difference(self.known)
        for w in [w for w in new if w in self.older]:
            self.known[w] = self.older[w]
            self.held += len(w)
        new = list(new.difference(self.known))
        self.known.update(zip(new, self.library(new)))
        self.held += sum(map(len, new))
        out = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in part]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
                self.held -= len(w)
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if not self.splits:
            return self.library(texts)
        out: list[int] = []
        part: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(self.split(text))
            size += len(part[-1])
            if size >= TOGETHER or i == len(texts) - 1:
                out += [int(n.sum()) for n in self._counts(part)]
                part, size = [], 0
        return out

    def boundaries(self, text: str, start: int, first: int, last: int, whole: int) -> dict:
        """A chunk that begins at ``start`` of a text of ``whole`` characters.

        Its tokens ``n``, and as ``left`` and ``right`` the boundaries, with the
        tokens before each, of its first characters up to ``first`` and of those
        from ``last`` on up to where they are proven.
        """
        words = self.split(text)
        tokens = self._counts([words])[0]
        at = start + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        before = np.cumsum(tokens)
        sure = len(text) - 1 - self.margin
        while sure > 0 and text[sure].isspace():
            sure -= 1
        left = at <= first if start else np.zeros(len(at), bool)
        right = (at >= last) & (at <= start + sure) if start + len(text) < whole else np.zeros(len(at), bool)
        return {"n": int(before[-1]), "left_at": at[left], "left_n": before[left], "right_at": at[right], "right_n": before[right]}


_held: dict[str, Tokenizer] = {}


def _kept(name: str, kind: str, sent: Broadcast) -> Tokenizer:
    if name not in _held:
        _held.clear()
        _held[name] = Tokenizer(sent.value, kind)
    return _held[name]


def tokenizer(spark: SparkSession, path: str) -> tuple[Callable[[], Tokenizer], bool]:
    """What gives a worker its tokenizer, and whether texts can be cut for it; the driver reads the file and broadcasts it."""
    content, kind = bpe.read_ranks(spark, path), path.rpartition(".")[2]
    name, sent = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)
    return (lambda: _kept(name, kind, sent)), Tokenizer(content, kind).splits


def spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text; each reaches ``overlap`` characters into the next."""
    n = max(1, length // chunk)  # the last takes the rest
    return [(i * chunk, length if i == n - 1 else (i + 1) * chunk + overlap) for i in range(n)]


_PIECES = "digest binary, i long, begin long, whole long, piece string"
_CODED = "digest binary, i long, last boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _spliced(texts: DataFrame, own: Callable[[], Tokenizer], chunk: int, overlap: int, scratch: Scratch, name: str) -> DataFrame:
    """(digest, n): the tokens of each text of (digest, text), null where neighbours have no proven boundary in common."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for i, (a, b) in enumerate(spans(len(text), chunk, overlap)):
                    yield pa.RecordBatch.from_pydict({"digest": [digest], "i": [i], "begin": [a], "whole": [len(text)], "piece": [text[a:b]]})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = own()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = known.boundaries(r["piece"], r["begin"], r["begin"] + overlap, r["begin"] + chunk, r["whole"])
                rows.append({"digest": r["digest"], "i": r["i"], "last": r["begin"] + len(r["piece"]) == r["whole"]} | found)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("digest", pa.binary()), ("i", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("left_at", "left_n", "right_at", "right_n"))]))

    # one text's chunks are dealt out to many tasks, none by a key
    pieces = texts.mapInArrow(cut, _PIECES).hint("rebalance")
    coded = scratch.table(pieces.mapInArrow(code, _CODED), name).dropDuplicates(["digest", "i"])
    right = coded.where("not last").select("digest", "i", "right_at", "right_n")
    left = coded.where("i > 0").select("digest", (F.col("i") - 1).alias("i"), "left_at", "left_n")
    at = F.try_element_at(F.array_intersect("right_at", "left_at"), F.lit(-1))
    of = lambda n, where: F.element_at(n, F.array_position(where, F.col("at")).cast("int"))
    joints = right.join(left, ["digest", "i"], "left").withColumn("at", at)
    joints = joints.select("digest", F.when(F.col("at").isNotNull(), of("right_n", F.col("right_at")) - of("left_n", F.col("left_at"))).alias("n"))
    ends = coded.where("last").select("digest", "n")
    return joints.unionByName(ends).groupBy("digest").agg(F.when(F.count("*") == F.count("n"), F.sum("n")).alias("n"))


def _huge(texts: DataFrame, own: Callable[[], Tokenizer], chunk: int, overlap: int) -> DataFrame:
    """(digest, n) of each text of (digest, text)."""
    scratch = Scratch(texts.sparkSession, "tokens")
    todo, out, size, lap = texts, None, chunk, overlap
    while True:
        found = scratch.table(_spliced(todo, own, size, lap, scratch, f"chunks-{size}"), f"counts-{size}")
        out = found.where("n is not null") if out is None else out.unionByName(found.where("n is not null"))
        open_ = found.where("n is null").select("digest")
        if open_.isEmpty():
            return out
        size, lap = size * WIDEN, lap * WIDEN
        todo = texts.join(open_, "digest", "left_semi")


def count(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add column ``out`` with the number of tokens of column ``text``; an existing ``out`` is replaced."""
    if overlap * 2 > chunk:
        raise ValueError("an overlap is at most half a chunk")
    spark = df.sparkSession
    ensure_importable(spark)
    own, splits = tokenizer(spark, path)

    @F.pandas_udf("long")
    def whole(s: pd.Series) -> pd.Series:
        return pd.Series(own().counts(s.fillna("").tolist()), index=s.index, dtype="int64")

    if not splits:
        return df.withColumn(out, whole(df[text]))
    key, found = unused(df, "_digest", "_found")
    columns = [c for c in df.columns if c != out]
    long = F.coalesce(F.length(df[text]), F.lit(0)) >= 2 * chunk
    digest = F.unhex(F.sha2(df[text], 256))
    counts = _huge(df.where(long).select(digest.alias("digest"), df[text].alias("text")), own, chunk, overlap).select(F.col("digest").alias(key), F.col("n").alias(found))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    few = df.where(~long).withColumn(out, whole(df[text])).select(*columns, out)
    many = df.where(long).withColumn(key, digest).select(*columns, key)
    many = many.join(counts, key, "left").select(*columns, F.col(found).alias(out))
    return few.unionByName(many)
