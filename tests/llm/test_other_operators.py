"""Small tests of the operators on pages, conversations and images."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.llm import media, preference, warc_zip
from lodestep.llm.components import components
from lodestep.llm.session import Scratch

PAGES = "page_id long, url string, html string"


def records(spark, folder, pages, **options):
    archives = warc_zip.write(spark.createDataFrame(pages, PAGES), folder, **options).cache()
    archives.count()
    return sorted(warc_zip.read(archives, folder).collect(), key=lambda r: (r.page_id is None, r.page_id)), archives


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_records_come_back(spark, tmp_path, broadcast, monkeypatch):
    monkeypatch.setattr(warc_zip, "BROADCAST_ROWS", broadcast)
    long = "x" * 300_000
    pages = [(3, "http://a/3", "<p>é</p>"), (1, "http://a/1", "<p>é</p>"), (2, None, None), (4, "u", ""), (5, "u", long), (None, "u", long), (1, "http://a/1", "<p>é</p>"), (6, "u", "\r\n\r\nodd")]
    got, archives = records(spark, f"file://{tmp_path}/w", pages)
    assert archives.agg(F.sum("records")).first()[0] == len(pages) == len(got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to, bytes(r.payload)) for r in by[1]] == [("response", None, "<p>é</p>".encode())] * 2
    assert [(r.record_type, r.refers_to, r.payload, r.payload_bytes) for r in by[3]] == [("revisit", 1, None, 9)]
    assert by[3][0].payload_digest == by[1][0].payload_digest == warc_zip.base32_sha1("<p>é</p>".encode())
    assert (by[2][0].record_type, by[4][0].refers_to, by[2][0].url) == ("response", 2, None)
    assert (by[None][0].record_type, by[None][0].refers_to) == ("revisit", 5)
    assert bytes(by[6][0].payload) == b"\r\n\r\nodd"


def test_least_bytes_small_archives_and_no_pages(spark, tmp_path):
    pages = [(i, "u", "same") for i in range(20)] + [(100 + i, "u", "a longer text") for i in range(20)]
    got, archives = records(spark, f"file://{tmp_path}/w", pages, least_bytes=10, archive_bytes=2000)
    assert archives.count() > 4
    assert {r.record_type for r in got[:20]} == {"response"} and [r.refers_to for r in got[20:]] == [None] + [100] * 19
    assert records(spark, f"file://{tmp_path}/e", [])[0] == []


def test_archive_without_index_and_zip64(tmp_path):
    import zipfile

    data = b"".join(warc_zip.record(i, "u", b"x" * i, warc_zip.base32_sha1(b"x" * i), None, False, "2024-01-01T00:00:00Z") for i in range(50))
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/one.warc", "w", force_zip64=True) as f:
            f.write(data)
        z.writestr(zipfile.ZipInfo("packed.txt"), "x" * 100, zipfile.ZIP_DEFLATED)
    raw = open(path, "rb").read()
    end = raw.rfind(b"PK\x05\x06")
    # the same directory, told of by the ZIP64 records only
    import struct

    count, length, start = struct.unpack("<HII", raw[end + 10 : end + 20])
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    both = [raw, raw[:end] + wide + locator + tail]
    for i, content in enumerate(both):
        other = tmp_path / f"b{i}.zip"
        other.write_bytes(content)
        file = warc_zip._Files(f"file://{tmp_path}")(str(other))
        archive = warc_zip.Archive(file, file.size())
        assert list(archive.members) == ["archive/one.warc"]
        got = [warc_zip.parse(archive.read(a, n)) for a, n in archive.ranges()]
        assert [(g["page_id"], g["payload"]) for g in got] == [(k, b"x" * k) for k in range(50)]
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parse(warc_zip.record(1, "u", b"x", warc_zip.base32_sha1(b"y"), None, False, "2024-01-01T00:00:00Z"))
    assert not glob.glob(f"{tmp_path}/*.part")


@pytest.mark.parametrize("index", ["indexes/index.cdx.gz", "indexes/index.cdxj", None, "partial.cdxj"])
def test_gzipped_records_and_other_types(tmp_path, index):
    import gzip
    import json
    import zipfile

    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    made = [info] + [warc_zip.record(i, f"http://a.example/{i}", b"y" * i, warc_zip.base32_sha1(b"y" * i), 1, i == 7, "2024-01-01T00:00:00Z") for i in range(9)]
    packed, at, lines = [gzip.compress(r) for r in made], 0, []
    for r in packed:
        lines.append(f"com,example)/ 20240101000000 {json.dumps({'offset': str(at), 'length': str(len(r)), 'filename': 'data.warc.gz'})}\n".encode())
        at += len(r)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"".join(packed))
        if index == "partial.cdxj":  # names no record of the second member
            z.writestr("archive/more.warc", made[2])
        if index:
            text = b"".join(lines)
            z.writestr(index, gzip.compress(text[:50]) + gzip.compress(text[50:]) if index.endswith(".gz") else text)
    file = warc_zip._Files(f"file://{tmp_path}")(str(tmp_path / "a.zip"))
    archive = warc_zip.Archive(file, file.size())
    got = [warc_zip.parse(archive.read(a, n)) for a, n in archive.ranges()]
    assert [g["record_type"] for g in got[:10]] == ["warcinfo", *["response"] * 7, "revisit", "response"]
    assert (got[0]["payload"], got[0]["payload_digest"], got[0]["page_id"]) == (b"a: b", None, None)
    assert [(g["page_id"], g["payload_bytes"]) for g in got[1:10]] == [(i, i) for i in range(9)]
    assert len(got) == 10 + (index == "partial.cdxj")


def test_members_that_cannot_be_read_are_named(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/packed.warc", "x" * 100)
    file = warc_zip._Files(f"file://{tmp_path}")(str(tmp_path / "a.zip"))
    with pytest.raises(ValueError, match="packed.warc"):
        list(warc_zip.Archive(file, file.size()).ranges())


def test_index_lines_are_sorted_by_key(spark, tmp_path):
    import zipfile

    pages = [(1, "http://b.example/x y", "1"), (2, "https://A.example/?q=1", "2"), (3, "odd\nline", "3"), (4, None, "4")]
    _, archives = records(spark, f"file://{tmp_path}/w", pages)
    keys = []
    for r in archives.collect():
        with zipfile.ZipFile(r.archive) as z:
            own = [line.split(" ")[:2] for line in z.read(warc_zip.INDEX).decode().splitlines()]
            assert own == sorted(own)
            keys += own
    assert sorted(keys) == sorted([["example,b)/x%20y", "20240101000000"], ["example,a)/?q=1", "20240101000000"], ["odd%20line", "20240101000000"], ["-", "20240101000000"]])


# Preferences

TURNS = "pair_id long, turn long, role string, text string, extra string"


def test_preference_pairs(spark):
    ask = [(1, 0, "system", "be kind", "x"), (1, 1, "user", "hi", "x")]
    chosen = spark.createDataFrame([*ask, (1, 2, "assistant", "hello", "x"), (1, 3, "user", "more", "x"), (1, 4, "assistant", "ok", "x"), (2, 0, "user", None, "x"), (None, 0, None, "n", "x"), (3, 0, "user", "only chosen", "x")], TURNS)
    rejected = spark.createDataFrame([*reversed(ask), (1, 2, "assistant", "go", "x"), (2, 0, "user", "", "x"), (2, 1, "assistant", "late", "x"), (None, 0, "", "n", "x")], TURNS)
    out = {r.pair_id: r for r in preference.pair(chosen, rejected).collect()}
    assert set(out) == {1, 2, None}
    one = out[1]
    assert one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 2
    assert [one.chosen_text[s.start : s.end] for s in one.chosen_spans] == ["hello<|end|>\n", "ok<|end|>\n"]
    assert [one.rejected_text[s.start : s.end] for s in one.rejected_spans] == ["go<|end|>\n"]
    assert (out[2].n_prompt_turns, out[2].chosen_text, [s.end for s in out[2].rejected_spans]) == (1, "", [len(out[2].rejected_text)])
    assert (out[None].chosen_text, out[None].rejected_text, out[None].prompt) == ("", "", "<||>\nn<|end|>\n")
    assert preference.pair(chosen.where("false"), rejected).count() == 0


# Images


def picture(seed, side=12, zoom=10):
    a = np.random.RandomState(seed).rand(1, side, side)
    return np.rint(media._resized(a, zoom)[0] * 255).astype(np.uint8)


def test_copies(spark):
    a, b = picture(1), picture(2)
    images = {1: a, 2: a[12:, 7:], 3: np.clip(a * 0.8 + 20, 0, 255), 4: np.rot90(a), 5: b, 6: b[:, :100], 7: picture(3), 8: np.zeros((50, 50)), 9: a}
    rows = [(i, media.encode(np.ascontiguousarray(x))) for i, x in images.items()] + [(10, None), (11, b""), (12, b"P5 9 9 255 short"), (13, b"")]
    df = spark.createDataFrame(rows, "image_id long, image binary").withColumn("id", F.lit("clash"))
    got = {r.image_id: (r.component_id, r.n_corners) for r in media.copies(df).collect()}
    assert [got[i][0] for i in range(1, 14)] == [1, 1, 1, 1, 5, 5, 7, 8, 1, 10, 11, 12, 11]
    assert got[8][1] == got[10][1] == got[12][1] == 0
    assert media.copies(df.where("false")).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_all_copies_of_a_crowded_bucket_are_linked(spark, broadcast, monkeypatch):
    monkeypatch.setattr(media, "BROADCAST_ROWS", broadcast)
    rows = [(i, media.encode(np.clip(picture(1) * (1 - i / 50) + i, 0, 255))) for i in range(14)] + [(20 + i, media.encode(picture(20 + i))) for i in range(4)]
    got = {r.image_id: r.component_id for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert got == {i: 0 for i in range(14)} | {i: i for i in range(20, 24)}


def test_crops_of_half_and_a_quarter(spark):
    images, rows = [picture(60 + i, side=24) for i in range(4)], []
    for i, a in enumerate(images):
        h, w = a.shape
        rows += [(10 * i + k, media.encode(np.ascontiguousarray(x))) for k, x in enumerate((a, a[h // 2 :], a[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4], a[h // 2 :, : w // 2]))]
    got = {r.image_id: r.component_id for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_one_patch_is_no_copy(spark):
    """The same tiles in another order share corners, and no transform."""
    tiles = [picture(80 + i, side=5, zoom=8) for i in range(9)]
    r, orders, rows = random.Random(2), [], []
    moved = lambda x, y: [complex(*divmod(y.index(k), 3)) - complex(*divmod(x.index(k), 3)) for k in range(9)]
    while len(orders) < 4:  # no two tiles move alike
        order = r.sample(range(9), 9)
        if all(len(set(moved(order, x))) == 9 for x in orders):
            orders.append(order)
    for i, order in enumerate(orders):
        a = np.concatenate([np.concatenate([tiles[k] for k in order[j : j + 3]], axis=1) for j in (0, 3, 6)])
        rows += [(10 * i, media.encode(a)), (10 * i + 1, media.encode(np.clip(a * 0.9 + 10, 0, 255)))]
    got = {x.image_id: x.component_id for x in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in rows), got


def test_recall_of_edits_against_brute_force(spark):
    """Brightened, blurred, noisy, cropped and turned copies: those that comparing all images finds, nine in ten of the planted ones, and no others."""
    noise, rows, planted = np.random.RandomState(5), [], set()
    for i in range(30):
        a = picture(200 + i, side=10, zoom=9).astype(float)
        edits = [a, a * 0.7 + 30, media._smooth(a[None])[0], a + noise.normal(0, 6, a.shape), a[9:, 5:], np.rot90(a, i % 4)]
        rows += [(10 * i + k, media.encode(np.ascontiguousarray(np.clip(np.rint(x), 0, 255)))) for k, x in enumerate(edits)]
        planted |= {(10 * i, 10 * i + k) for k in range(1, 6)}
    df = spark.createDataFrame(rows, "image_id long, image binary")
    reps = media.corners(df).where("n > 0").withColumnRenamed("id", "rep").cache()
    every = reps.select(F.col("rep").alias("a")).join(reps.select(F.col("rep").alias("b")), F.col("a") < F.col("b"))
    brute = {(r.a, r.b) for r in media._verified(every, reps, media.CONSENSUS).collect()}
    assert all(a // 10 == b // 10 for a, b in brute)
    got = {r.image_id: r.component_id for r in media.copies(df).collect()}
    assert all(got[i] // 10 == i // 10 for i in got)
    assert len({i for i in got if got[i] != i // 10 * 10}) <= 0.1 * len(got)
    assert sum(got[a] == got[b] for a, b in brute) >= 0.9 * len(brute) and len(planted & brute) >= 0.9 * len(planted)


def test_image_rows_without_ids_and_of_one_id(spark):
    a, b = media.encode(picture(1)), media.encode(picture(2))
    df = spark.createDataFrame([(5, a), (None, a), (None, b), (7, a), (7, b), (8, b), (None, None), (9, a), (9, a)], "image_id long, image binary").withColumn("digest", F.lit("clash")).withColumn("rep", F.lit(0))
    got = media.copies(df).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.image_id in (5, 9)} == {5}
    assert sorted({r.component_id for r in got if r.image_id is None}, key=str) in ([5, 7, None], [5, None])
    with pytest.raises(TypeError, match="whole numbers"):
        media.copies(df.withColumn("image_id", F.lit("x")))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {x.node: x.least for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "t").collect()}
    alone = {n for n in least if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: m for n, m in least.items() if n not in alone}


def resized(a, scale, degrees=0):
    """An edited picture: made smaller or larger, and turned about its middle."""
    a = media._resized(media._smooth(a[None].astype(float)) if scale < 0.7 else a[None].astype(float), scale)[0]
    h, w = a.shape
    t, (y, x) = np.deg2rad(degrees), np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    fy = (np.cos(t) * (y - cy) - np.sin(t) * (x - cx) + cy).clip(0, h - 1.001)
    fx = (np.sin(t) * (y - cy) + np.cos(t) * (x - cx) + cx).clip(0, w - 1.001)
    j, i = fy.astype(int), fx.astype(int)
    return np.rint((a[j, i] * (1 - fy + j) + a[j + 1, i] * (fy - j)) * (1 - fx + i) + (a[j, i + 1] * (1 - fy + j) + a[j + 1, i + 1] * (fy - j)) * (fx - i)).clip(0, 255).astype(np.uint8)


def linked(a, b):
    """Whether two images meet in enough buckets and have a consensus, as ``copies`` asks."""
    d = [media.describe(x[None]) for x in (a, b)]
    places = [np.stack([e[k] for k in ("x", "y", "size", "angle")], axis=1).astype(np.float64) for e in d]
    packed = [np.packbits(e["bits"].astype(bool), axis=1) for e in d]
    if len(np.intersect1d(*(np.unique(media._keys(x)) for x in packed))) < media.MEET:
        return False
    x, y = media._near(*(np.ascontiguousarray(v).view(np.uint64).reshape(-1, 4) for v in packed))
    if min(len(np.unique(x)), len(np.unique(y))) < media.CONSENSUS:
        return False
    image = np.repeat([0, 1], [len(v) for v in places])
    return len(media._agreeing(x, y + len(places[0]), image, np.concatenate(places), media.CONSENSUS)[0]) > 0


def test_resized_pairs_are_linked():
    for i in range(2):
        a = picture(300 + i)
        assert all(linked(a, resized(a, *e)) for e in ((0.45, 0), (0.53, 7), (0.6, 15), (0.77, 7), (0.9, 0), (0.9, 15), (1.1, 7), (1.3, 0), (1.6, 7)))
    assert not any(linked(picture(500 + i), picture(600 + i)) for i in range(5))


def test_recall_of_resized_copies(spark):
    """Copies of odd scales, straight and turned: nine in ten of those that are planted, and no others."""
    edits = [(0.45, 0), (0.53, 7), (0.6, 0), (0.6, 15), (0.77, 7), (0.9, 0), (0.9, 15), (1.1, 7), (1.3, 0), (1.6, 7)]
    rows = []
    for i in range(3):
        a = picture(300 + i)
        rows += [(100 * i + k, media.encode(x)) for k, x in enumerate([a, *(resized(a, *e) for e in edits)])]
    got = {r.image_id: r.component_id for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[i] // 100 == i // 100 for i in got)
    assert sum(got[i] == i // 100 * 100 for i in got) >= 0.9 * len(got), sorted(i for i in got if got[i] != i // 100 * 100)


@pytest.mark.parametrize("pairs", [1 << 21, 200])
def test_matches_are_nearest_ones(pairs, monkeypatch):
    """In blocks as at once: within the bound, and nearest to one of both."""
    monkeypatch.setattr(media, "PAIRS", pairs)
    r = np.random.RandomState(3)
    a = r.randint(0, 256, (60, 32)).astype(np.uint8)
    b = np.concatenate([a[:40], a[20:50]]) ^ (r.rand(70, 32) < 0.15).astype(np.uint8)
    words = [np.ascontiguousarray(x).view(np.uint64).reshape(-1, 4) for x in (a, b)]
    bits = np.unpackbits(a[:, None] ^ b[None], axis=2).sum(2)
    near = {(i, j) for i in range(60) for j in range(70) if bits[i, j] <= media.NEAR and bits[i, j] in (bits[i].min(), bits[:, j].min())}
    assert set(zip(*(x.tolist() for x in media._near(*words)))) == near and len(near) > 60


def test_a_consensus_of_many_corners_takes_bounded_memory():
    """Ten thousand matches, a third of them right, and as many wrong ones alone."""
    import tracemalloc

    r = np.random.RandomState(1)
    n = 10_000
    p = np.column_stack([r.uniform(0, 2000, (n, 2)), np.ones(n), np.zeros(n)])
    z = (p[:, 0] + 1j * p[:, 1]) * 0.9 * np.exp(0.1j) + (30 + 50j)
    right = r.rand(n) < 0.34
    q = np.column_stack([np.where(right, z.real, r.uniform(0, 2000, n)), np.where(right, z.imag, r.uniform(0, 2000, n)), np.ones(n), np.zeros(n)])
    tracemalloc.start()
    assert media._on_one_transform(p, q, np.arange(0, n, 3), p, q, media.CONSENSUS)
    wrong = np.column_stack([r.uniform(0, 2000, (n, 2)), np.ones(n), np.zeros(n)])
    assert not media._on_one_transform(p, wrong, np.arange(0, n, 3), p, wrong, media.CONSENSUS)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
