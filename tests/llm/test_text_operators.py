"""Small tests of the operators on documents: plain cases, nulls, empties, ties, and brute force."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lodestep.llm import bpe, decontaminate, license_scan, near_dup, pii, queries, secret_scan, toxicity

DOCS = "doc_id long, text string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    codec = bpe.Codec(Path(queries.RANKS).read_bytes(), queries.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_bpe_is_the_librarys(library):
    codec, known = library
    r = random.Random(1)
    letters = " aebcdthin'sé\n\t\x1c\x85 0१中😀ABC--__ßœ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(120))) for _ in range(600)]
    texts += ["", "a" * 3000, "ab" * 2000, " " * 500, "中" * 300, "we'll  it's\r\n <|endoftext|>"]
    coded = codec.encode(texts)
    assert [ids(c) for c in coded] == [known.encode_ordinary(t) for t in texts]
    assert [codec.decode(c).decode() for c in coded] == texts


def test_one_tree_and_many_agree(library):
    codec, _ = library
    words = [w.encode() for w in ("hello", "xqzjk", "aaaa", "é中", "incomprehensibilities")]
    assert codec._merge_together(words, 32) == [codec.merge_alone(w) for w in words]


def test_bpe_columns(spark):
    df = docs(spark, ["hello world", "", None]).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, queries.RANKS, queries.PATTERN), queries.RANKS, queries.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in out] == ["hello world", "", ""]
    assert [len(r.ids) for r in out] == [8, 0, 0]


# Secrets


def base(text):
    """The patterned spans as the contract words them."""
    found = []
    for order, (kind, pattern, least) in enumerate(
        (
            ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12),
            ("access", re.compile(r"()(AKIA[A-Z0-9]+)"), 18),
            ("hex", re.compile(r"()([0-9a-f]+)"), 16),
        )
    ):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[2]) >= least]
    return [x for _, _, x in sorted(found)]


def test_patterned_spans():
    r = random.Random(2)
    parts = ["password", "Secret", "api_key", "TOKEN", "=", ": ", '"', "AKIA", "ABCD1234", "deadbeef", "0123", "é", " ", "zz9", "-", "ſ"]
    scanner = secret_scan.Scanner()
    for _ in range(800):
        text = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        assert [f"{k}:{a}:{b}" for k, a, b in scanner.spans(text) if k != "entropy"] == base(text)


def test_entropy_and_allow_list():
    scanner = secret_scan.Scanner()
    key = "aB3xQ9zLk2mN8vRt5yWp7"
    assert [s[0] for s in scanner.spans(f"see {key} there")] == ["entropy"]
    assert scanner.spans(f"password={key}") == [("assign", 0, 9 + len(key))]
    assert scanner.spans("see 123e4567-e89b-12d3-a456-426614174000") == []
    assert scanner.spans(f"see EXAMPLE{key}") == []
    assert scanner.spans("internationalizationally spoken words") == []


def test_window_counts_are_those_of_each_window():
    import math
    from collections import Counter

    scanner, kind = secret_scan.Scanner(), secret_scan.CLASSES[1]
    r = random.Random(4)
    for _ in range(50):
        run = "".join(r.choice("abAB01cdCD23xyzXYZ") for _ in range(40))
        marked = set()
        for i in range(len(run) - 19):
            w = run[i : i + 20]
            h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
            if h >= kind.bits - 1e-9 and all(sum(c in need for c in w) >= least for need, least in kind.needs):
                marked |= set(range(i, i + 20))
        assert {p for a, b in scanner.windows(run, kind) for p in range(a, b)} == marked


def test_redact(spark):
    df = docs(spark, ["a password=abcdefghijkl1 b", None, "", "clean"])
    assert [r.text for r in secret_scan.redact(df).orderBy("doc_id").collect()] == ["a [secret] b", None, "", "clean"]
    found = secret_scan.scan(df.withColumn("spans", F.lit(1))).orderBy("doc_id").collect()
    assert [len(r.spans) for r in found] == [1, 0, 0, 0]


# Toxicity


def test_toxicity(spark):
    rows = [(i, f"some words here {'you idiotic fool' if i % 2 else 'you kind friend'} and more of number {i}", i % 2) for i in range(60)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    texts = ["you IDIOTIC person", "you 1d10t1c person", "you іdiоtic person", "you kind person", "", None]
    got = toxicity.score(docs(spark, texts).withColumn("score", F.lit("clash")), lexicon, hits="n").orderBy("doc_id").collect()
    assert [r.n > 0 for r in got] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in got) and min(r.score for r in got[:3]) > max(r.score for r in got[3:])
    spared = toxicity.Lexicon(lexicon.entries, (toxicity.fold("idiotic fool"),), lexicon.slope, lexicon.offset)
    assert toxicity.weigh("an idiotic fool", spared) == (0.0, 0)
    assert toxicity.weigh("10101 1", lexicon)[1] == 0
    empty = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert empty.entries == ()


def test_training_rows_are_bounded_and_held_out(spark):
    d = docs(spark, [f"t{i}" for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(d, labels, rows=10, held_out=queries.held_out(F.col("doc_id"))).collect()
    assert len(rows) == 10 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


# Decontamination


def contaminated(texts, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(len(v), size)
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("words", [1_000_000, 0])
def test_decontamination_is_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(decontaminate.occurrences, "__defaults__", (*decontaminate.occurrences.__defaults__[:-1], words))
    r = random.Random(7)
    pool = ["alpha", "Beta", "gämma", "d4", "ÉX", "x"]
    make = lambda n: "".join(r.choice(pool) + r.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, make(r.choice([1, 2, 3, 5, 6, 7, 9]) if i % 3 else 0)) for i in range(8)] + [(None, make(6)), (99, None), (98, "Only One OF these words is not in the pool xx")]
    texts = [make(r.randrange(60)) for _ in range(40)] + ["", None, "!!!", "only one of THESE words is not in the pool xx"]
    texts.append(texts[0])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs(spark, texts), bench, size=6).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r.hit_items)) for r in found] == contaminated(texts, items, 6)
    kept = {r.doc_id for r in decontaminate.remove_documents(docs(spark, texts), bench, size=6).collect()}
    assert kept == {i for i, x in enumerate(contaminated(texts, items, 6)) if not x[1]}


def test_remove_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    df = docs(spark, ["Zero, One two; THREE four. Five", "nothing here", None])
    out = [r.text for r in decontaminate.remove_spans(df, bench, size=4).orderBy("doc_id").collect()]
    assert out == ["Zero,  . Five", "nothing here", None]


def test_no_benchmark(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, ["a b", None]), empty).where("n_hit > 0").count() == 0


# Near duplicates


def groups(texts, words, share=(4, 5)):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    least = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and least[i] != least[j] and share[1] * len(a & b) >= share[0] * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return [(len(s), m) for s, m in zip(sets, least)]


@pytest.mark.parametrize("words, broadcast, similarity", [(2, 500_000, 0.8), (5, 500_000, 0.8), (5, 0, 0.8), (2, 500_000, 0.6)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, words, broadcast, similarity):
    monkeypatch.setattr(near_dup, "SHORT", 6)  # so that longer lists take the exact way too
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", broadcast)
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return w

    core = make(120)
    texts = [edited(core, r.randrange(0, 16)) for _ in range(30)]
    texts += [w for n in (3, 5, 6, 8, 20, 300) for b in [make(n)] for w in (b, edited(b, 1), b + make(1), edited(b, max(1, n // 20)))]
    texts += [make(60) + core[:50] for _ in range(12)]
    texts += [edited(core[:100] + make(8), r.randrange(0, 5)) for _ in range(20)]  # a crowd around one passage
    texts = [" ".join(w) for w in texts] + ["", None, "   ", "one", "ONE", "one two", "a b", "b a"]
    r.shuffle(texts)
    found = near_dup.near_duplicates(docs(spark, texts), words=words, similarity=similarity).orderBy("doc_id").collect()
    wanted = groups(texts, words, (round(similarity * 10), 10))
    assert [(x.n_shingles, x.component_id) for x in found] == wanted
    assert [x.kept for x in found] == [m == i for i, (_, m) in enumerate(wanted)]


def test_near_duplicate_rows_without_ids(spark):
    long = "a b c d e f g h i j"
    df = spark.createDataFrame([(5, long), (None, long), (None, "x y z"), (None, "x y z"), (7, "k l m"), (7, "k l m")], "doc_id long, text string")
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(df, words=2).collect())
    assert found == [("5", "5", True), ("7", "7", True), ("7", "7", True), ("None", "5", False), ("None", "None", True), ("None", "None", True)]
    assert near_dup.deduplicate(df.withColumn("key", F.lit("clash"))).count() == 5
    assert near_dup.near_duplicates(df.where("false")).count() == 0


def test_similarities_that_no_run_serves_are_refused(spark):
    assert [near_dup.run_length(s) for s in (0.5, 0.7, 0.8, 0.95)] == [1, 2, 3, 3]
    for bad in (0.05, 0.2):
        with pytest.raises(ValueError, match="sketches"):
            near_dup.near_duplicates(docs(spark, ["a"]), similarity=bad).count()
    with pytest.raises(TypeError, match="whole numbers"):
        near_dup.near_duplicates(docs(spark, ["a"]).withColumn("doc_id", F.lit("x")))


def test_whole_sets_of_a_similarity_have_a_common_run():
    r = np.random.RandomState(3)
    for similarity in (0.6, 0.7, 0.8, 0.9):
        length = near_dup.run_length(similarity)
        for _ in range(3000):
            u = np.sort(r.choice(10**6, r.randint(1, 43), replace=False)).astype(np.int64)
            out = r.permutation(len(u))[: r.randint(0, int(len(u) * (1 - similarity) + 1e-9) + 1)]
            side = r.rand(len(out)) < 0.5
            a, b = np.delete(u, out[side]), np.delete(u, out[~side])
            if len(a) == len(b) == len(u) or len(np.intersect1d(a, b)) < similarity * len(u) - 1e-9 or not len(a) or not len(b):
                continue
            assert len(np.intersect1d(near_dup.run_keys(a, length, similarity), near_dup.run_keys(b, length, similarity)))


# Licenses


def test_licenses(spark, monkeypatch):
    r = random.Random(3)
    filler = lambda n: " ".join(r.choice(["der", "the", "of", "under", "work", "is"]) for _ in range(n))
    texts = [f"{filler(i * 3)} {text} {filler(40 - i)}" for i, (_, text) in enumerate(license_scan.NOTICES)]
    n = len(texts)
    texts += ["Released under the MIT", "released UNDER the mit license", "", None, filler(500)]

    def edited(text, every):  # each so many words another, and wrapped
        words = text.split()
        return "\n * ".join(" ".join("foo" if (i + j) % every == every - 1 else w for j, w in enumerate(words[i : i + 9])) for i in range(0, len(words), 9))

    texts += [filler(20) + edited(text, every) for every in (12, 25) for _, text in license_scan.NOTICES if len(text.split()) > 40]
    sets = lambda t: [x for x in zip(*(lambda w: (w, w[1:]))(re.findall(r"[0-9a-z]+", (t or "").lower())))]
    wanted = {}
    for i, t in enumerate(texts):  # naive: the best window of any place and length up to twice the template's
        have = sets(t)
        for name, template in license_scan.NOTICES:
            own = set(sets(template))
            room = len(sets(template)) + 1
            if any(len(own & set(have[k : k + room])) >= 0.8 * len(own) for k in range(max(1, len(have) - room + 1))):
                wanted.setdefault(i, set()).add(name)
    found = {}
    for few in (True, False):
        if not few:
            monkeypatch.setattr(license_scan, "ANCHORED", 0)
            monkeypatch.setattr(license_scan, "BROADCAST_WORDS", 0)
        found = {}
        for x in license_scan.scan(docs(spark, texts), license_scan.notices(spark)).collect():
            assert x.n_found >= 0.8 * x.n_shingles
            found.setdefault(x.doc_id, set()).add(x.license)
        for i, names in wanted.items():
            assert names <= found[i], (i, names - found[i])
        assert found.get(n) is None and "MIT" in found[n + 1] and not {n + 2, n + 3, n + 4} & set(found)
        assert all(license_scan.NOTICES[i][0] in found[i] for i in range(n))
    none = spark.createDataFrame([], "license string, text string")
    assert license_scan.scan(docs(spark, texts), none).count() == 0


# Personal data


def test_pseudonyms(spark):
    text = "Mail bosbt.42@mail8.example.com, +1 (988) 555-2485, card 4111 1111 1111 1111, 10.0.0.7, 2024-02-29, 123-45-6789; not 2023-02-29, 4111111111111112, 999.1.1.1"
    df = docs(spark, [text, f"again 4111 1111 1111 1111 and {text}", "", None, "nothing"])
    named = pii.pseudonymise(df, b"key")
    a, b, *rest = named.orderBy("doc_id").collect()
    kinds = [s.kind for s in a.pii_spans]
    assert kinds == ["email", "phone", "card", "ip", "date", "ssn"]
    values = [a.text[s.start : s.end] for s in a.pii_spans]
    original = pii.Pseudonymiser(b"key")
    assert all(original.valid(k, v) for k, v in zip(kinds, values))
    for old, new in zip(("bosbt.42", "+1 (988) 555-2485", "4111 1111 1111 1111"), values):
        assert old not in a.text and re.sub(r"\d", "9", old)[:3].isalpha() == new[:3].isalpha()
    assert b.text.count(values[2]) == 2
    assert a.text.endswith("not 2023-02-29, 4111111111111112, 999.1.1.1")
    assert [r.text for r in rest] == ["", None, "nothing"]
    assert [r.text for r in pii.reveal(named, b"key").orderBy("doc_id").collect()] == [t if t is None else t for t in [text, f"again 4111 1111 1111 1111 and {text}", "", None, "nothing"]]
    assert pii.pseudonymise(df, b"other").first().text != a.text


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k", "t", 1000)
    seen = [f.permute(i) for i in range(1000)]
    assert sorted(seen) == list(range(1000)) and [f.permute(x, True) for x in seen] == list(range(1000))


def noted(found):
    out = {}
    for x in found.collect():
        out.setdefault(x.doc_id, set()).add(x.license)
    return out


@pytest.mark.parametrize("few", [True, False])
def test_each_place_has_its_one_right_license(spark, monkeypatch, few):
    """Found sets equal the wanted ones: every notice alone, inside text, wrapped, edited, and three in one text."""
    if not few:
        monkeypatch.setattr(license_scan, "ANCHORED", 0)
        monkeypatch.setattr(license_scan, "BROADCAST_WORDS", 0)
    r = random.Random(3)
    filler = lambda n: " ".join(r.choice(["der", "the", "of", "under", "work", "is", "to", "in"]) for _ in range(n))
    shingles = lambda t: set(zip(*(lambda w: (w, w[1:]))(re.findall(r"[0-9a-z]+", t.lower()))))

    def wrapped(text, every, off):  # each so many words another
        words = text.split()
        return "\n * ".join(" ".join("foo" if (i + j + off) % every == every - 1 else w for j, w in enumerate(words[i : i + 9])) for i in range(0, len(words), 9))

    texts, wanted = [], []
    for k, (name, notice) in enumerate(license_scan.NOTICES):
        texts += [notice, f"{filler(k)} {notice} {filler(30)}", filler(5) + "\n" + wrapped(notice, 10**6, 0)]
        wanted += [{name}] * 3
        for every, off in ((12, 0), (12, 5), (25, 3)):
            edited = wrapped(notice, every, off)
            # of all templates it must hold this one best, without a tie: an edit may take what tells two apart
            scores = sorted(((2 * len(shingles(t) & shingles(edited)) - len(shingles(t)), n) for n, t in license_scan.NOTICES), reverse=True)
            if len(notice.split()) > 40 and len(shingles(notice) & shingles(edited)) >= 0.8 * len(shingles(notice)) and scores[0][1] == name and (scores[0][0] > scores[1][0] or scores[1][1] == name):
                texts.append(f"{filler(20)} {edited} {filler(9)}")
                wanted.append({name})
    assert len(texts) > 3 * len(license_scan.NOTICES) + 20
    for _ in range(40 if few else 5):
        some = r.sample(license_scan.NOTICES, 3)
        texts.append(" ".join(f"{filler(r.randrange(6))} {notice}" for _, notice in some))
        wanted.append({name for name, _ in some})
    twice = license_scan.NOTICES[15][1]
    texts += [f"{twice} {filler(200)} {twice}", "", None, filler(700)]
    wanted += [{license_scan.NOTICES[15][0]}, set(), set(), set()]
    found = noted(license_scan.identify(docs(spark, texts), license_scan.notices(spark)))
    assert {i: found.get(i, set()) for i in range(len(texts))} == dict(enumerate(wanted))
    both = license_scan.places(docs(spark, texts[-4:-3]), license_scan.notices(spark)).orderBy("first_word").collect()
    n = len(re.findall(r"[0-9A-Za-z]+", twice))
    assert [(x.first_word, x.end_word) for x in both] == [(0, n), (n + 200, 2 * n + 200)]


def test_licenses_among_some_hundred_templates(spark):
    """Templates of a few families that share most of their words, each told from its relatives."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for family in range(20):
        base = [word() for _ in range(60)]
        for kind in range(15):
            own = list(base)
            own[10 + kind] = word()
            own.insert(40, word())
            rows.append((f"{family}-{kind}", " ".join(own)))
    templates = spark.createDataFrame(rows, "license string, text string")
    asked = r.sample(rows, 60)
    texts = [" ".join([*(word() for _ in range(i)), text, *(word() for _ in range(40))]) for i, (_, text) in enumerate(asked)]
    assert noted(license_scan.identify(docs(spark, texts), templates)) == {i: {name} for i, (name, _) in enumerate(asked)}
    assert license_scan.identify(docs(spark, texts), templates.where("false")).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "aA", "etaoin", "abcdefghijklmnopqrstuvwxyz", "的一是不中é", "xyXY"])
def test_long_words_in_one_tree_are_the_librarys(library, alphabet):
    codec, known = library
    r = random.Random(alphabet)
    words = ["".join(r.choice(alphabet) for _ in range(n)) for n in (65, 100, 333, 2000) for _ in range(5)]
    words += ["".join(r.choice(["the", "ing", "tion", "abab", "aaa", "qu", "un", "re"]) for _ in range(n)) for n in (40, 300) for _ in range(5)]
    raw = [w.encode() for w in words]
    wanted = [[x for part in known._core_bpe.encode_ordinary(w) for x in [part]] if len(regex.findall(queries.PATTERN, w)) == 1 else None for w in words]
    for got in (codec.merge_side_by_side(raw), codec.merge_side_by_side(raw[::-1])[::-1], [codec.merge_alone(w) for w in raw]):
        assert all(w is None or ids(g) == w for g, w in zip(got, wanted))
    assert sum(w is not None for w in wanted) > 20


def test_long_words_are_merged_together_and_forgotten(library):
    codec, known = library
    r = random.Random(7)
    text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(4000)) for _ in range(60)) + " short words"
    assert ids(codec.encode([text])[0]) == known.encode_ordinary(text)
    assert max(map(len, codec.known)) <= bpe.WIDE
