"""Token counts, ranked search and importance resampling against the library and the plain way."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from lodestep.llm import importance, lexical_search, queries, token_count, words

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ("_digest", "_found", "n", "i", "digest", "id", "row", "score", "rank", "key", "words", "term", "place", "part", "eligible")


def frame(spark, rows):
    """Rows with other columns of names that operators use inside."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"other {c}") for c in CLASHES})


# Token counts


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    return lambda text: len(own.encode(text or "", add_special_tokens=False))


def odd_texts(r):
    letters = " aebcdthin'sé\n\t\x1c\x85　 0１中😀ABC--ß"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(400))) for _ in range(60)]
    texts += ["", None, "a" * 700, " " * 500, "ab " * 150 + " " * 300 + "x", "we'll it's\r\n" * 40, "中" * 300, "x" + "'" * 90 + "ll" * 60]
    texts += ["<|endoftext|>" * 30, "ab<|endoftext|> c " * 25, "<|endofte" * 40, ("  " * 9 + "<|endoftext|>") * 20, "it'" + "s'" * 100]
    return texts


@pytest.mark.parametrize("chunk,overlap", [(32, 16), (60, 30), (64, 4), (8192, 256)])
def test_counts_are_the_librarys(spark, library, chunk, overlap):
    """Whatever the chunks, with special strings, spaces and words across their borders, and where no overlap aligns."""
    texts = odd_texts(random.Random(chunk))
    got = {r.doc_id: r.n_tokens for r in token_count.count(frame(spark, list(enumerate(texts))), queries.TOKENIZER, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: library(t) for i, t in enumerate(texts)}


def test_overlaps_are_widened_until_they_align(spark, library, monkeypatch):
    sizes, spliced = [], token_count._spliced
    monkeypatch.setattr(token_count, "_spliced", lambda texts, own, size, lap, *a: (sizes.append((size, lap)), spliced(texts, own, size, lap, *a))[1])
    texts = ["plain words " * 40, "a" * 3000 + " end", "-" * 900]
    got = [r.n_tokens for r in token_count.count(frame(spark, list(enumerate(texts))), queries.TOKENIZER, chunk=64, overlap=16).orderBy("doc_id").collect()]
    assert got == [library(t) for t in texts]
    assert sizes == [(64 * 4**i, 16 * 4**i) for i in range(len(sizes))] and 3 <= len(sizes) <= 5
    with pytest.raises(ValueError, match="half"):
        token_count.count(frame(spark, [(1, "x")]), queries.TOKENIZER, chunk=10, overlap=6)


def test_boundaries_are_those_of_the_whole_text():
    """Every boundary that the left chunk proves is one of the whole text, wherever the chunk ends."""
    own = token_count.Tokenizer(open(queries.TOKENIZER, "rb").read(), "json")
    text = "It's  a   <|endoftext|> we'll\n\n see'  \t 'll <|endofte xt 12中中 'v 're  "
    whole = set(np.cumsum([len(w) for w in own.split(text)]).tolist())
    proven = 0
    for a in (0,):
        for b in range(1, len(text)):
            found = own.boundaries(text[a:b], a, 0, 0, len(text))
            assert set(found["right_at"].tolist()) <= whole
            proven += len(found["right_at"])
    assert proven > 200


def test_token_count_rows_stay(spark, library):
    rows = [(1, "tie of words " * 9), (1, "tie of words " * 9), (None, None), (None, "x"), (3, "")]
    df = frame(spark, rows).withColumn("n_tokens", F.lit("replaced"))
    out = token_count.count(df, queries.TOKENIZER, chunk=32, overlap=8)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == sorted((str(i), library(t)) for i, t in rows)
    assert {tuple(r[c] for c in CLASHES) for r in out.collect()} == {tuple(f"other {c}" for c in CLASHES)}
    assert token_count.count(df.where("false"), queries.TOKENIZER).count() == 0


def test_other_tokenizers_take_whole_texts(spark):
    import public_tokenizers
    import sentencepiece

    texts = ["Some words here, Some more.", "", "一些 words " * 20]
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = [r.n_tokens for r in token_count.count(frame(spark, list(enumerate(texts))), path, chunk=8, overlap=2).orderBy("doc_id").collect()]
    assert got == [len(own.encode(t)) for t in texts]
    path = public_tokenizers.path("word_bpe_49k.json")
    known = tokenizers.Tokenizer.from_file(path)
    got = [r.n_tokens for r in token_count.count(frame(spark, list(enumerate(texts))), path, chunk=8, overlap=2).orderBy("doc_id").collect()]
    assert got == [len(known.encode(t, add_special_tokens=False)) for t in texts]


# Words


def test_pieces_never_cut_a_word():
    r = random.Random(3)
    text = "".join(r.choice("abC9é中 -\n_") for _ in range(5000))
    plain = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))]
    for size in (1, 7, 100, 10**6):
        assert [w for part in words.pieces(text.encode(), size) for w in part] == plain
    assert list(words.pieces(b"")) == list(words.pieces(b" -- ")) == []


# Ranked search


def plain_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(r, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "x" * 90, "The", "the"]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=r.randrange(0, 40))) for _ in range(n)]
    return texts


@pytest.mark.parametrize("block,fan,pairs", [(1, 2, 40), (3, 2, 10**6), (64, 8, 300)])
def test_search_is_the_plain_one(spark, monkeypatch, block, fan, pairs):
    """Trees of every shape; ties, copies, repeated ids, null ids and texts, items without words."""
    for name, value in (("BLOCK", block), ("FAN", fan), ("TREE_PAIRS", pairs)):
        monkeypatch.setattr(lexical_search, name, value)
    r = random.Random(block)
    texts = corpus(r, 250)
    docs = [(i, t) for i, t in enumerate(texts)] + [(900 + i, texts[0]) for i in range(30)] + [(5, texts[5]), (None, texts[7]), (None, None), (901, "")]
    items = [(i, t) for i, t in enumerate(corpus(r, 25))] + [(3, "w1 w2"), (None, "w5 W5 größe"), (77, None), (78, "nowhere"), (79, "")]
    d = frame(spark, docs).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1))
    got = sorted((tuple(x) for x in lexical_search.search(d, q, k=12).collect()), key=str)
    assert got == plain_search(docs, items, 12)


def test_search_in_groups_of_queries_and_empty_tables(spark, monkeypatch):
    r = random.Random(9)
    docs, items = list(enumerate(corpus(r, 80))), list(enumerate(corpus(r, 12)))
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 700)
    d, q = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(x) for x in lexical_search.search(d, q, k=5).collect()), key=str) == plain_search(docs, items, 5)
    assert lexical_search.search(d.where("false"), q).count() == lexical_search.search(d, q.where("false")).count() == 0


def test_a_tree_opens_few_leaves(monkeypatch):
    """Bounds prune: one document far above the rest is found without scoring all blocks."""
    n = 64 * 512
    impacts = np.full(n, 10, np.int64)
    impacts[20_000] = 500
    tree = lexical_search.Trees(np.arange(n + 1), np.zeros(n, np.int64), impacts)
    opened, push = [], lexical_search.heapq.heappop
    monkeypatch.setattr(lexical_search.heapq, "heappop", lambda q: (opened.append(1), push(q))[1])
    best: list = []
    tree.search(np.zeros(1, np.int64), np.ones(1, np.int64), best, 1, lambda i: i)
    assert best == [(-500, 20_000)] and len(opened) < 10
    best = []
    tree.search(np.zeros(1, np.int64), np.ones(1, np.int64), best, 3, lambda i: i)
    assert best == [(-500, 20_000), (-10, 0), (-10, 1)]  # of equal bounds, the least ids


# Importance resampling


def plain_resample(docs, target, least, share):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for *_, f in held for x in f), Counter(x for text in target for x in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 24), (50, 40)])
def test_resampling_is_the_plain_one(spark, monkeypatch, block, part):
    """Also where blocks are small and long texts stand in several; nulls, empties, words longer than the tables."""
    monkeypatch.setattr(importance, "BLOCK", block)
    monkeypatch.setattr(importance, "PART", part)
    if part < 100:
        monkeypatch.setattr(words.pieces, "__defaults__", (16,))
    r = random.Random(4)
    texts = [*corpus(r, 60), "", None, "one", "-- --", "y" * 200 + " " + "z" * 65 + " é", "many words here " * 60]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3])]
    target = [*corpus(r, 9), None, ""]
    got = importance.resample(frame(spark, docs).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), least=10, share=(1, 3)).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_resample(docs, target, 10, (1, 3))


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    docs, target = [(1, "a tie of words")] * 3 + [(2, "a tie of words")], spark.createDataFrame([("of words",)], "text string")
    got = importance.resample(frame(spark, docs), target, least=1, share=(1, 1)).collect()
    assert len(got) == 4 and sorted(x["rank"] for x in got) == [1, 2, 3, 4] and len({(x.doc_id, x.score) for x in got}) == 2
    assert importance.resample(frame(spark, docs).where("false"), target).count() == 0
    assert importance.resample(frame(spark, docs), target.where("false"), least=1).count() == 4


def test_checksums_of_joined_strings():
    r = random.Random(2)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 2, 5, 63, 64, 65, 300, 5000)]
    pairs = [(a, b) for a in parts for b in parts]
    crc = lambda side: np.array([zlib.crc32(p[side]) for p in pairs], np.uint32)
    got = importance._join(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# Queries


@pytest.mark.parametrize("name", ["op11_token_count", "op13_importance"])
def test_queries_on_the_smallest_tables(spark, library, name):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(x) for x in queries.queries()[name](spark, sf).collect()), key=str)
    if name == "op11_token_count":
        wanted = [(i, len((t or "").encode()), library(t), library(t) > 1024) for i, t in docs]
    else:
        wanted = plain_resample(docs, [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 20, (5, 100))
    assert got == sorted(wanted, key=str)
