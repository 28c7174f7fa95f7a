"""Edge cases of every operator on documents: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestep.llm import bpe, decontaminate, license_scan, near_dup, pii, preference, queries, secret_scan, toxicity

#: Names that operators use inside, or once did.
CLASHES = ("_rated", "_pii", "_key", "_digest", "_norm", "_words", "_gaps", "digest", "norm", "key", "words", "gaps", "n", "k", "rep", "label", "item", "prompt", "hits")
LONG = "word and more words of a very long text 0123 " * 8000
BENCH = "item_id long, text string"


def lexicon(spark):
    return toxicity.Lexicon((("idiot", 5.0), ("scu*", 4.0)), ("trash can",), 3.0, -3.0)


def add_benchmark(spark):
    return spark.createDataFrame([(1, "a tie of words that stand in several texts at once today"), (1, None), (None, "")], BENCH)


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, lexicon(s), out="new"),
    "pii": lambda s, d: pii.pseudonymise(d, b"k", spans="new"),
    "pii back": lambda s, d: pii.reveal(d, b"k"),
    "bpe": lambda s, d: bpe.round_trip(d, queries.RANKS, queries.PATTERN, ids="new", decoded=None),
    "secrets": lambda s, d: secret_scan.scan(d, out="new"),
    "redaction": lambda s, d: secret_scan.redact(d),
    "contamination": lambda s, d: decontaminate.contamination(d, add_benchmark(s)).drop("n_words", "n_hit", "hit_items").withColumnRenamed("hit_spans", "new"),
    "removal": lambda s, d: decontaminate.remove_documents(d, add_benchmark(s)),
    "removal of spans": lambda s, d: decontaminate.remove_spans(d, add_benchmark(s)),
    "near duplicates": lambda s, d: near_dup.deduplicate(d),
}
TIE = "a tie of words that stand in several texts at once today"
KEPT = {"removal": {"n", "e", "s", "l"}, "near duplicates": {"n", "e", "s", "l", "t"}}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, None, "n"), (2, "", "e"), (3, " \n\t", "s"), (4, LONG, "l"), (5, TIE, "t"), (6, TIE, "t"), (6, TIE, "t"), (None, TIE, "t"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    return df.withColumns({c: F.concat(F.lit(c), F.col("mark")) for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_other_columns_stay(spark, table, name):
    out = OPERATORS[name](spark, table)
    assert [c for c in out.columns if c != "new"] == table.columns
    got = out.drop("new").collect()
    assert {r.mark for r in got} == KEPT.get(name, {"n", "e", "s", "l", "t"})
    assert name in KEPT or len(got) == 9
    assert all(r[c] == c + r.mark for r in got for c in CLASHES)
    assert all(r.text is None for r in got if r.mark == "n")
    assert all(r.text == t for r in got for m, t in (("e", ""), ("s", " \n\t")) if r.mark == m)
    if name == "near duplicates":
        assert [r.doc_id for r in got if r.mark == "t"] == [5]
    if name == "removal of spans":
        assert {r.text for r in got if r.mark == "t"} == {" "}
    if name in ("bpe", "toxicity", "secrets", "contamination"):  # ties get the same
        assert len({str(r.new) for r in out.where("mark = 't'").select("new").collect()}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, table, name):
    out = OPERATORS[name](spark, table.where("false"))
    assert out.count() == 0 and [c for c in out.columns if c != "new"] == table.columns


def test_toxicity_against_a_plain_scorer(spark):
    import math
    import re

    lex = toxicity.Lexicon((("idiot", 5.0), ("scu*", 4.0), ("trash", 3.0)), (toxicity.fold("trash can"),), 3.0, -3.0)
    texts = ["an idiot", "idiots aren't", "SCUMMY scu", "the trash can", "trash canned", "1d10t!!!", "$cum", "misidiot", "a trash, can", "10101", "ТRАSН", "", LONG + " idiot"]

    def plain(t):
        folded = toxicity.fold(t)
        total = 0.0
        for m in re.finditer(r"[^\W_]\S*|[$@!|+€]\S*", t):
            own = folded[m.start() : m.end()].split(" ")[0]
            word = own[: len(re.match(r"[\w$@!|+€]*?(?=[!|+]*$|[^\w$@!|+€])", m.group()).group())] if m.group() else own
            if not any(c.isalpha() for c in m.group()):
                continue
            if word == "trash" and re.match(r"trash can\b", t[m.start() :], re.I):
                continue
            total += 5.0 if word == "idiot" else 3.0 if word == "trash" else 4.0 if own.startswith("scu") else 0.0
        return 1 / (1 + math.exp(-(3.0 * total / math.sqrt(10 + len(folded.split())) - 3.0)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(df, lex).orderBy("doc_id").collect()]
    assert [round(x, 9) for x in got] == [round(plain(t), 9) for t in texts]


def test_harmless_words_that_begin_alike_are_left_alone(spark):
    bad = ["you are a disgusting idiot and a pathetic moron", "a stupid worthless loser spoke", "you trash talk and you are trash"]
    good = ["a fine day with kind people and words", "the report is here and you are right"] * 20 + ["a trash can stands there"]
    rows = [(i, f"{bad[i % 3]} number {i}", 1) for i in range(90)] + [(100 + i, f"{good[i % 41]} number {i}", 0) for i in range(410)]
    lex = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), exceptions=())
    assert toxicity.fold("trash can") in lex.exceptions
    for t in ("a disguise for the party", "an idiosyncratic style of writing", "we lose our keys now and then", "the clowns in the circus were funny", "put it into the trash can"):
        assert toxicity.weigh(t, lex)[1] == 0, t
    assert all(toxicity.weigh(t, lex)[1] for t in ("you idiot", "such trash", "a m0r0n"))


def test_pseudonyms_of_all_kinds(spark):
    values = {
        "phone": ["555-123-4567", "(555) 123-4567", "+1 555 123 4567"], "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
        "card": ["3782-822463-10005", "378282246310005"], "date": ["12/31/1999", "31.12.1999", "1999-12-31", "1999/12/31"], "ipv6": ["2001:0DB8:85a3::8a2e:0370:7334", "2001:db8:85a3::8a2e:370:7334"],
    }
    names = pii.Pseudonymiser(b"key")
    for kind, forms in values.items():
        new = []
        for v in forms:
            text, spans = names.text(f"x {v}, y")
            assert [s["kind"] for s in spans] == [kind] and text != f"x {v}, y", v
            value = text[spans[0]["start"] : spans[0]["end"]]
            assert names.valid(kind, value) and (kind == "ipv6" or [c.isdigit() for c in value] == [c.isdigit() for c in v] or kind == "iban")
            assert names.text(text, True)[0] == f"x {v if kind != 'ipv6' else forms[1]}, y"
            new.append(value)
        plain = {"".join(c for c in v if c.isalnum())[-10:] for v in new} if kind != "date" else {str(pii._day(v)) for v in new}
        assert len(plain) == 1, (kind, new)
    assert names.text("+442071234567")[0][1:] == names.text("+44 2071234567")[0][1:].replace(" ", "")
    for alone in ("DE88 3704 0044 0532 0130 00", "13/13/1999", "31.02.1999", "12:30:45", "a::b", "x555-123-45678", "378282246310006"):
        assert names.text(f"x {alone} y")[1] == [], alone


def test_dates_with_the_day_first_come_back():
    import datetime

    names = pii.Pseudonymiser(b"key")
    seen = set()
    for i in range(400):
        day = datetime.date(1990, 1, 13) + datetime.timedelta(17 * i)
        if day.day > 12:
            v = f"{day:%d/%m/%Y}"
            new = names.text(v)[0]
            seen.add(new)
            assert names.text(new, True)[0] == v and int(new[:2]) > 12
    assert len(seen) > 200


def test_secrets_of_runs_and_long_texts():
    import time

    scanner = secret_scan.Scanner()
    for c in "a0_-Z=":
        for n in (20, 21, 10_000):
            assert [s for s in scanner.spans(c * n) if s[0] == "entropy"] == []
    key = "aB3xQ9zLk2mN8vRt5yWp7"
    assert scanner.spans(f"EXAMPLE{'q' * 300}{key}") == []
    assert scanner.spans(f"sample_key={key}") == [("entropy", 11, 11 + len(key))]
    assert [k for k, _, _ in scanner.spans("see 4kq8zt1vwx7p0ymr2hbn there and QK4Z8TV1WX7P0YMR2HBN")] == ["entropy", "entropy"]
    took = []
    for n in (4_000, 16_000):
        text = "\n".join(f"password=abcdefghijk{i} {key}" for i in range(n))
        began = time.process_time()
        assert len(scanner.spans(text)) >= 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_dashed_rules_in_documents(spark, table):
    df = spark.createDataFrame([(1, "a\n" + "-" * 21 + "\nb", "en"), (2, "_" * 400, "en")], "doc_id long, text string, lang string")
    assert [len(r.spans) for r in secret_scan.scan(df).collect()] == [0, 0]
    assert {r.text for r in secret_scan.redact(df).collect()} == {"a\n" + "-" * 21 + "\nb", "_" * 400}


def test_all_secret_spans_against_brute_force():
    """Windows, joining, suppression and cover, each the plain way."""
    import math
    import random
    import re
    from collections import Counter

    scanner, r = secret_scan.Scanner(), random.Random(9)
    parts = ["password=", "sample_key=", "EXAMPLE", "-" * 20, " ", "\n", "AKIA", "0123", "=", "_", "123e4567-e89b-12d3-a456-426614174000"]
    word = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    for _ in range(400):
        text = "".join(r.choice([r.choice(parts), word("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", r.randrange(10, 30)), word("0123456789abcdef", r.randrange(10, 30)), word("abcz0189", 25)]) for _ in range(r.randrange(8)))
        marked = set()
        for kind in secret_scan.CLASSES:
            for i in range(len(text) - 19):
                w = text[i : i + 20]
                h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
                if re.fullmatch(f"[{kind.chars}]+", w) and h >= kind.bits - 1e-9 and all(sum(c in need for c in w) >= least for need, least in kind.needs):
                    marked |= {(i, i + 20)}
        joined = []
        for a, b in sorted(marked):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        base = [(a, b) for k, a, b in scanner.spans(text) if k != "entropy"]
        wanted = []
        for a, b in joined:
            value = re.compile("[A-Za-z0-9+/_-]*")
            start = a
            while start and value.fullmatch(text[start - 1 : b]):
                start -= 1
            end = b
            while end < len(text) and value.fullmatch(text[start : end + 1]):
                end += 1
            if not any(s <= a and b <= e for s, e in base) and not any(re.fullmatch(p, x) for p in secret_scan.ALLOW for x in (text[a:b], text[start:end])):
                wanted.append((a, b))
        assert [(a, b) for k, a, b in scanner.spans(text) if k == "entropy"] == wanted, text


def test_preference_outputs_and_nulls(spark):
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, None, [("user", LONG)], "x"), (2, [("user", "a")], None, "x"), (3, None, None, "x"), (3, None, None, "x")], f"pair_id long, chosen {turns}, rejected {turns}, prompt string").withColumn("_a", F.lit("a")).withColumn("n", F.lit("b"))
    out = preference.format_pairs(df)
    assert out.columns == ["pair_id", "_a", "n", *preference.OUTPUTS]
    got = out.orderBy("pair_id").collect()
    assert [(r.n_prompt_turns, r.prompt, r._a, r.n) for r in got] == [(0, "", "a", "b")] * 4
    assert LONG in got[0].rejected_text and got[1].chosen_text == "<|user|>\na<|end|>\n" and got[2].rejected_text == ""
    assert preference.format_pairs(df.where("false")).count() == 0


def test_licenses_of_odd_rows(spark, table):
    notice = license_scan.notices(spark)
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "all rights reserved"), (None, "Released under the MIT License."), (None, "x Released under the MIT License.")], "doc_id long, text string").withColumn("words", F.lit(1))
    got = sorted((str(r.doc_id), r.license) for r in license_scan.scan(df, notice).collect())
    assert got == [("1", "MIT"), ("1", "rights-reserved"), ("None", "MIT"), ("None", "MIT")]
    assert license_scan.scan(table, notice).count() == 0 and license_scan.scan(table.where("false"), notice).count() == 0


def test_pattern_of_ones_own_keeps_every_word():
    pattern = r"(?i:'s|'t)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s+(?!\S)|\s+"
    codec = bpe.Codec(Path(queries.RANKS).read_bytes(), pattern)
    text = "Hello world's 12345  é\n"
    assert "".join(codec.split(text)) == text and codec.decode(codec.encode([text])[0]).decode() == text
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    import numpy as np

    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == known.encode_ordinary(text)


def test_generations_of_remembered_words(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    codec, fresh = bpe.Codec(Path(queries.RANKS).read_bytes(), queries.PATTERN), bpe.Codec(Path(queries.RANKS).read_bytes(), queries.PATTERN)
    texts = [f"common xq{i} words zv{i % 7} {i}" for i in range(200)]
    assert codec.encode(texts) == [fresh.encode([t])[0] for t in texts] and len(codec.known) + len(codec.older) < 200


def test_ranks_are_bounded_and_read_by_any_address(spark, tmp_path, monkeypatch):
    plain = Path(queries.RANKS).read_bytes()
    assert bpe.read_ranks(spark, f"file://{queries.RANKS}") == plain == bpe.read_ranks(spark, queries.RANKS)
    monkeypatch.setattr(bpe, "RANK_BYTES", 1000)
    for path in (queries.RANKS, f"file://{queries.RANKS}"):
        with pytest.raises(ValueError, match="larger"):
            bpe.read_ranks(spark, path)


def test_the_package_sent_to_executors_is_whole(tmp_path):
    import subprocess
    import sys

    from lodestep.llm import session

    path = session._archive(str(tmp_path))
    said = subprocess.run([sys.executable, "-I", "-c", f"import sys; sys.path.insert(0, {path!r}); from lodestep.llm import bpe, near_dup; print(bpe.__file__)"], capture_output=True, text=True)
    assert path in said.stdout, said.stderr


def test_long_keys_are_not_the_likelier_to_be_passed_over():
    """Runs and sequences inside a key hide nothing; a string that is mostly one is no key."""
    import base64

    scanner, r = secret_scan.Scanner(), random.Random(6)
    body = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW"
    assert [k for k, _, _ in scanner.spans(body)] == ["entropy"]
    pem = base64.b64encode(r.randbytes(1200)).decode().replace("=", "")
    lines = "\n".join(pem[i : i + 64] for i in range(0, 1536, 64))
    covered = sum(b - a for k, a, b in scanner.spans(lines))
    assert covered > 0.8 * len(lines)
    for inside in ("0123456789", "abcdefghij", "AAAAAAAAAAAA", "xExampleX", "dummy"):
        for at in (100, 300, 600):
            blob = pem[:at] + inside + pem[at:648]
            spans = scanner.spans(blob)
            assert sum(b - a for _, a, b in spans) > 0.8 * len(blob), (inside, at)
    for dummy in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdefghijklmnopqrstuvwxyz", "k0123456789abcdefQ7x", "AKIB" + "IOSFODNN7aQ3xEXAMPLE", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "sk_dummy_aB3xQ9zLk2mN8vRt5yWp7"):
        assert scanner.spans(dummy) == [], dummy
