"""The pipeline against brute force on a small corpus, and its contract."""

import random
from pathlib import Path

import corpus_pipeline
from test_text_operators import contaminated, groups, ids

import tiktoken
from lodestep.llm import bpe, queries, secret_scan


def test_pipeline(spark, tmp_path):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    item = make(14)
    texts = {}
    for i in range(60):
        texts[i] = " ".join(make(60))
    for i in range(60, 100):  # toxic by two words, half of them labelled
        texts[i] = " ".join([*make(20), "vilewordish", *make(10), "vilewordish", *make(20)])
    texts[100] = texts[3]
    texts[101] = texts[4] + " onemore"
    texts[102] = " ".join([*make(30), *item[2:13], *make(5)])
    texts[103] = " ".join([*make(20), "password=abcdefghij123456", *make(20)])
    texts[104], texts[105] = "", None
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 100)) for i in range(0, 100, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = [i for i in texts if not 60 <= i < 100]
    least = [clean[m] for _, m in groups([texts[i] for i in clean], 5)]
    single = [i for i, m in zip(clean, least) if i == m]
    free = [i for i, hit in zip(single, contaminated([texts[i] for i in single], [(1, " ".join(item))], 10)) if not hit[1]]
    assert {100, 101, 102} & set(free) == set()

    codec = bpe.Codec(Path(queries.RANKS).read_bytes(), queries.PATTERN)
    known = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(free)
    for i in free:
        text = texts[i] or ""
        for _, a, b in reversed(secret_scan.Scanner().spans(text)):
            text = text[:a] + "[secret]" + text[b:]
        assert ids(got[i].ids) == known.encode_ordinary(text) and got[i].n_tokens == len(got[i].ids) // 4 and got[i].intact
    assert "[secret]" in codec.decode(got[103].ids).decode()


def test_stages_keep_the_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "secret scan", "byte-level BPE"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs, str(tmp_path)).count() == 0
