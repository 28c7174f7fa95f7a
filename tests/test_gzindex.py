"""One gzip file read by many tasks: every cut gives the same lines."""

import gzip
import io
import random
import zlib

import pyarrow as pa
import pytest

from lodestep.plans import queries
from lodestep.sources import dump, gzindex


def cut_everywhere(data, every=1):
    """A gzip file with the border of a block after each ``every`` bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join(deflate.compress(data[i : i + every]) + deflate.flush(zlib.Z_BLOCK) for i in range(0, len(data), every)) + deflate.flush()


def file(data):
    return pa.PythonFile(io.BytesIO(data), mode="r")


def read(packed, span):
    found = list(gzindex.points(file(packed), "x", span))
    assert found[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(found, found[1:]))
    return found, [line for p in found if p["start"] < p["stop"] for line in gzindex.stretch_lines(file(packed), *(p[k] for k in ("begin", "bits", "start", "stop", "before", "fresh")))]


def plain(data):
    return data.removesuffix(b"\n").split(b"\n") if data else []


TEXTS = [b"", b"\n", b"one line", b"one\n", b"\n\n\nend", b"a\nbb\n\nccc\n\xff\xfe\nlast \xc3\xa9", b"x" * 50 + b"\n" + b"yz" * 40, b"-- x\nVALUES (1,0,'a'),(2,0,'b');\n" * 12]


@pytest.mark.parametrize("data", TEXTS)
def test_a_cut_at_every_byte(data):
    for every in (1, 2, 7):
        packed = cut_everywhere(data, every)
        assert gzip.decompress(packed) == data
        found, lines = read(packed, 1)
        assert lines == plain(data)
        assert len(found) >= len(data) // every - 1
    assert read(gzip.compress(data), 1)[1] == plain(data)


def test_members_padding_and_large_texts():
    r = random.Random(2)
    words = [bytes(r.choices(b"abcdefgh \n", k=r.randrange(1, 30))) for _ in range(3000)]
    data = b"".join(r.choices(words, k=120_000))
    for packed in (gzip.compress(data), b"".join(gzip.compress(data[i : i + 100_001]) for i in range(0, len(data), 100_001)) + bytes(600)):
        for span in (1, 50_000, 10**9):
            found, lines = read(packed, span)
            assert lines == plain(data)
            assert len(found) == 1 if span > len(data) else len(found) >= 8


def test_damaged_files_are_errors():
    packed = gzip.compress(bytes(random.Random(1).randbytes(200_000)))
    for bad in (packed[:-9], packed[:1000], packed[:5000] + b"\0" * 50 + packed[5050:], b"no gzip file"):
        with pytest.raises(ValueError):
            list(gzindex.points(file(bad), "x", 1))


def test_many_tasks_read_one_file(spark, tmp_path):
    rows = [f"({i},{i % 3},{i * 7})" for i in range(60_000)]
    text = "".join(f"INSERT INTO `pagelinks` VALUES {','.join(rows[i : i + 50])};\n" for i in range(0, len(rows), 50)).encode()
    path = tmp_path / "enwiki-20240101-pagelinks.sql.gz"
    path.write_bytes(gzip.compress(text, 1))
    lines = gzindex.lines(spark, str(path), span=100_000)
    assert lines.rdd.getNumPartitions() >= 6
    sizes = lines.rdd.glom().map(len).collect()
    assert sum(s > 0 for s in sizes) >= 6 and sum(sizes) == 1200
    found = dump.parse(lines, "pagelinks").where("not malformed").drop("malformed")
    assert sorted(map(tuple, found.collect())) == [(i, i * 7) for i in range(60_000)]
    # the points are used again, and made again for another file
    before = sorted(p.name for p in (tmp_path / f"{path.name}.points").iterdir())
    gzindex.index(spark, str(path))
    assert sorted(p.name for p in (tmp_path / f"{path.name}.points").iterdir()) == before
    path.write_bytes(gzip.compress(b"other\nlines"))
    assert [r.value for r in gzindex.lines(spark, f"file://{path}").collect()] == ["other", "lines"]


def test_broken_bytes_stay(spark, tmp_path):
    path = tmp_path / "page.sql.gz"
    row = b"(%s,0,'%s',0,1,0.5,'1',NULL,1,1,NULL,NULL)"
    path.write_bytes(gzip.compress(b"VALUES " + b",".join([row % (b"1", b"ok"), row % (b"3", b"\xff")]) + b";\n"))
    for lines in (gzindex.lines(spark, str(path)), dump.lines(spark, str(path))):
        assert {(r.reason, r.n) for r in dump.statistics(dump.parse(lines, "page"), "page").collect()} == {("stored", 1), ("malformed", 1), ("attempted", 2)}


def test_files_are_joined_as_members(spark, tmp_path):
    """What many tasks wrote is one gzip file, in their order, which plain readers take too."""
    rows = spark.range(5000, numPartitions=7).selectExpr("concat('line ', id) as value")
    rows.write.text(str(tmp_path / "parts"), compression="gzip")
    path = gzindex.joined(spark, str(tmp_path / "parts"), str(tmp_path / "new" / "whole.gz"))
    wanted = [f"line {i}" for i in range(5000)]
    assert gzip.decompress(open(path, "rb").read()).decode().split() == [w for line in wanted for w in line.split()]
    assert sorted(r.value for r in gzindex.lines(spark, path, span=1000).collect()) == sorted(wanted)
    assert sorted(r.value for r in dump.lines(spark, path).collect()) == sorted(wanted)


def test_no_task_makes_the_whole_split_dump(spark, tmp_path, monkeypatch):
    """The rows of the dump are sorted and packed by many tasks, not by the one that makes the file."""
    read = []
    monkeypatch.setattr(gzindex, "lines", lambda s, path, span: read.append(path) or dump.lines(s, path))
    spark.range(30000).selectExpr("id div 5 as l_orderkey", "cast(id % 5 as int) as l_linenumber", "id % 700 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(700).selectExpr("id as p_partkey", "concat('p ', id) as p_name", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda self, n: pytest.fail("one task makes it all"))
    assert queries.dump_split_pagelinks(spark, str(tmp_path)).count() == 24000
    assert read[0].endswith("pagelinks.sql.gz")
