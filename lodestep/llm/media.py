"""Cropped or edited copies of images, by local descriptors.

Images are binary portable greymaps (P5, 8 bits) in a column.  Corners are found
at several scales by the Harris response; each gets an orientation from the
intensity centroid around it, and a descriptor of 256 binary intensity tests in
a pattern turned by that orientation.  Descriptors are entered into Hamming
tables, each keyed by some of the bits.  Images that meet in ``MEET`` buckets are
compared: corners match if one's descriptor is the nearest to the other's and they
differ in at most ``NEAR`` bits, so that a pattern which stands all over two
pictures isn't a match of each with each.  A match proposes a similarity transform.  Its scale is only that of two levels,
so the matches that agree on scale, rotation and shift, in bins that overlap by
half, propose again, by twos; the best of these transforms is fitted to all
matches that it takes, again until they stay.  Enough of them, spread over more
than a patch, no corner twice, and that are a share of the corners in the part
that both images show, are a consensus and link the images.

Images of equal bytes form a class, and only one of a class goes on.  A bucket is
not expanded into pairs: first its images meet a pivot, the one of the least
hash, which is the same in most buckets of a group of copies; the links make
components, and only in buckets whose images lie in several components do those
of different components meet, all of them.  So every two images that share
``MEET`` buckets are either in one component or compared, however crowded the
buckets are.  Only the work on buckets of many images that aren't copies grows
with the square of their number; keys of ``BITS`` bits keep those small.

A null, empty, broken or flat image has no corners and links with nothing but
images of the same bytes, null excepted.  Ids are whole numbers, others are
refused.  Rows of equal ids count as one image; if they hold different ones, that
of the least digest is compared for all.  Rows without an id get the component
of an image with the same bytes, or null.  An empty table gives an empty one;
images are read whole, ``STACK`` pixels at a time.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from .components import components
from .session import Scratch, ensure_importable

#: Scales; every corner of each is kept.
LEVELS = tuple(1.2**-i for i in range(6))
TABLES, BITS, MEET = 10, 48, 2
#: Bits in which descriptors that match differ at most, and matches that must agree.
NEAR, CONSENSUS = 32, 5
#: Pixels, at the coarser of two corners' scales, that a match may lie off the transform of its consensus, and that it must spread over.
OFF, WIDE = 2.0, 16.0
#: Matches of a bin from which transforms are proposed, others that each is paired with, and numbers that are compared at once.
ANCHORS, PARTNERS, CELLS = 12, 24, 1 << 20
#: Share of the corners in the part that two images have in common that must match, as chance matches grow with corners.
SHARE = 0.25
#: Share of the corners of one of two images that must lie in the other, as a crop's do.
WITHIN = 0.6
#: Pairs of corners that are compared at once, pixels of a stack, and pairs of images in a batch.
PAIRS, STACK, BATCH = 1 << 21, 1 << 20, 128
#: Rows of a few numbers that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_REACH, _MARGIN = 9, 8
_HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels of a greymap, or None if it is none."""
    head = _HEADER.match(data or b"")
    if not head:
        return None
    w, h, top = map(int, head.groups())
    body = data[head.end() :]
    return np.frombuffer(body, np.uint8, w * h).reshape(h, w) if w and h and top < 256 and len(body) >= w * h else None


def encode(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


@functools.lru_cache(maxsize=1)
def _tests() -> np.ndarray:
    """The 256 pairs of points (y, x, y, x), the same everywhere; evenly spread, so that their bits depend little on each other."""
    return np.random.RandomState(8).uniform(-_REACH, _REACH, (256, 4))


@functools.lru_cache(maxsize=1)
def _chosen() -> np.ndarray:
    """The bits that key each table."""
    r = np.random.RandomState(9)
    return np.stack([np.sort(r.choice(256, BITS, replace=False)) for _ in range(TABLES)])


def _smooth(a: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        p = np.pad(a, [(2, 2) if i == axis else (0, 0) for i in range(3)], mode="edge")
        take = lambda k: np.take(p, np.arange(k, k + a.shape[axis]), axis)  # noqa: B023, E731
        a = (take(0) + 4 * take(1) + 6 * take(2) + 4 * take(3) + take(4)) / 16
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    out = a
    for axis in (1, 2):
        n = max(1, round(a.shape[axis] * scale))
        at = np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, a.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, a.shape[axis] - 1)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(3)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def _corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of all corners of a stack."""
    gy, gx = np.gradient(a, axis=(1, 2))
    xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = np.zeros_like(r, bool)
    inner[:, _MARGIN:-_MARGIN, _MARGIN:-_MARGIN] = True
    p = np.pad(r, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    peak = inner & (r > 1e-3)
    for dy in range(3):
        for dx in range(3):
            peak &= r >= p[:, dy : dy + r.shape[1], dx : dx + r.shape[2]]
    return np.nonzero(peak)


def describe(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of images of one shape: image, x and y in the original, size, angle, and 256 bits."""
    out: dict[str, list] = {k: [] for k in ("image", "x", "y", "size", "angle", "bits")}
    window = np.arange(-6, 7)
    disc = (window[:, None] ** 2 + window[None, :] ** 2) <= 36
    for scale in LEVELS:
        a = _smooth(_resized(stack.astype(np.float64), scale))
        if min(a.shape[1:]) <= 2 * _MARGIN:
            continue
        image, y, x = _corners(a)
        if not len(image):
            continue
        patch = a[image[:, None, None], y[:, None, None] + window[None, :, None], x[:, None, None] + window[None, None, :]] * disc
        angle = np.arctan2((patch * window[None, :, None]).sum((1, 2)), (patch * window[None, None, :]).sum((1, 2)))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        t = _tests()
        value = []
        for k in (0, 2):
            ty = np.rint(y[:, None] + s * t[None, :, k + 1] + c * t[None, :, k]).astype(int).clip(0, a.shape[1] - 1)
            tx = np.rint(x[:, None] + c * t[None, :, k + 1] - s * t[None, :, k]).astype(int).clip(0, a.shape[2] - 1)
            value.append(a[image[:, None], ty, tx])
        for k, v in (("image", image), ("x", x / scale), ("y", y / scale), ("size", np.full(len(x), 1 / scale)), ("angle", angle), ("bits", value[0] < value[1])):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.empty((0, 256) if k == "bits" else 0) for k, v in out.items()}


def corners(images: DataFrame, id_: str = "image_id", image: str = "image") -> DataFrame:
    """(id, digest, n, places, descriptors) of every row: SHA-256 of the bytes; x, y, size and angle as floats, and 32 bytes, of each corner."""
    ensure_importable(images.sparkSession)

    def find(batches):
        for pdf in batches:
            held = [bytes(b) if b is not None else None for b in pdf["image"]]
            shapes: dict[tuple, list[int]] = {}
            for i, b in enumerate(held):
                if (p := decode(b)) is not None:
                    shapes.setdefault(p.shape, []).append(i)
            n, places, packed = np.zeros(len(held), np.int64), [b""] * len(held), [b""] * len(held)
            for (h, w), rows in shapes.items():
                step = max(1, STACK // (h * w))
                for j in range(0, len(rows), step):
                    part = rows[j : j + step]
                    d = describe(np.stack([decode(held[i]) for i in part]))
                    own = d["image"].astype(int)
                    order = np.argsort(own, kind="stable")
                    place = np.stack([d[k] for k in ("x", "y", "size", "angle")], axis=1).astype(np.float32)[order]
                    bits = np.packbits(d["bits"].astype(bool), axis=1)[order]
                    ends = np.searchsorted(own[order], np.arange(len(part) + 1))
                    for i, a, b in zip(part, ends, ends[1:]):
                        n[i], places[i], packed[i] = b - a, place[a:b].tobytes(), bits[a:b].tobytes()
            digest = [hashlib.sha256(b).digest() if b is not None else None for b in held]
            yield pd.DataFrame({"id": pdf["id"], "digest": digest, "n": n, "places": places, "descriptors": packed})

    rows = images.select(F.col(id_).cast("long").alias("id"), F.col(image).cast("binary").alias("image"))
    return rows.mapInPandas(find, "id long, digest binary, n long, places binary, descriptors binary")


def _keys(packed: np.ndarray) -> np.ndarray:
    """The bucket of each descriptor in each table, as numbers that differ from table to table."""
    bits = np.unpackbits(packed, axis=1)
    weights = 1 << np.arange(BITS, dtype=np.int64)
    return np.stack([(bits[:, chosen].astype(np.int64) @ weights) * TABLES + t for t, chosen in enumerate(_chosen())])


def _entries(reps: DataFrame) -> DataFrame:
    """(rep, key): the buckets of each image, once."""

    def enter(batches):
        for batch in batches:
            reps_, keys = [], []
            for rep, packed in zip(batch.column("rep").to_pylist(), batch.column("descriptors")):
                own = np.unique(_keys(np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 32)))
                reps_.append(np.full(len(own), rep, np.int64))
                keys.append(own)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps_)), pa.array(np.concatenate(keys))], ["rep", "key"])

    return reps.select("rep", "descriptors").mapInArrow(enter, "rep long, key long")


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row that is equal where all columns are."""
    out, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        c = c.astype(np.int64) - int(c.min())
        span = int(c.max()) + 1
        if size * span >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            size = int(out.max()) + 1
        if size * span >= 1 << 62:
            c = np.unique(c, return_inverse=True)[1]
            span = int(c.max()) + 1
        out, size = out * span + c, size * span
    return out


def _inside(at: np.ndarray, frame: np.ndarray) -> int:
    """How many points lie among the corners of an image."""
    return int(((at.real >= frame.real.min()) & (at.real <= frame.real.max()) & (at.imag >= frame.imag.min()) & (at.imag <= frame.imag.max())).sum())


def _possible(scale):
    """Whether corners can match at a scale: between those of the levels, and a little more."""
    return (scale > 0.9 * LEVELS[-1]) & (scale * 0.9 * LEVELS[-1] < 1)


def _proposed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities (turn, shift) through two matches each of a bin: evenly spread ones, each with those farthest from it."""
    turns, shifts = [], []
    for i in np.unique(np.linspace(0, len(u) - 1, ANCHORS).astype(int)):
        far = np.abs(u - u[i])
        other = np.argsort(-far, kind="stable")[:PARTNERS]
        other = other[far[other] > 4]
        turn = (v[other] - v[i]) / (u[other] - u[i])
        turns.append(turn)
        shifts.append(v[i] - turn * u[i])
    turn, shift = np.concatenate(turns), np.concatenate(shifts)
    real = _possible(np.abs(turn))
    return turn[real], shift[real]


def _on_one_transform(p: np.ndarray, q: np.ndarray, some: np.ndarray, ours: np.ndarray, theirs: np.ndarray, consensus: int) -> bool:
    """Whether a similarity takes enough corners p to their q, no corner twice.

    ``p`` and ``q`` are all matches (x, y, size, angle) of two images; those at
    ``some`` propose similarities, as their own scales are coarse.  The one that
    takes the most matches is fitted to these, again until they stay.  Enough are
    ``consensus``, and ``SHARE`` of all corners of either image (``ours``,
    ``theirs``) that it takes into the other; they spread over ``WIDE`` pixels,
    more than one patch; and it takes most of one image into the other.
    """
    every, each = ours[:, 0] + 1j * ours[:, 1], theirs[:, 0] + 1j * theirs[:, 1]
    u, v = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    off = OFF * np.maximum(p[:, 2], q[:, 2])
    turns, shifts = _proposed(u[some], v[some])
    if not len(turns):
        return False
    step = max(1, CELLS // len(u))
    taken = np.concatenate([(np.abs(turns[i : i + step, None] * u + shifts[i : i + step, None] - v) <= off).sum(axis=1) for i in range(0, len(turns), step)])
    best = int(np.argmax(taken))
    turn, shift = turns[best], shifts[best]
    on = np.abs(turn * u + shift - v) <= off
    for _ in range(8):
        if on.sum() < consensus or not np.ptp(np.abs(u[on] - u[on][0])):
            return False
        x, y = u[on] - u[on].mean(), v[on] - v[on].mean()
        turn = (np.conj(x) * y).sum() / (np.abs(x) ** 2).sum()
        shift = v[on].mean() - turn * u[on].mean()
        if not _possible(abs(turn)):
            return False
        now = np.abs(turn * u + shift - v) <= off
        if (now == on).all():
            break
        on = now
    if on.sum() < consensus:
        return False
    shown = _inside(turn * every + shift, each), _inside((each - shift) / turn, every)
    if shown[0] < WITHIN * len(every) and shown[1] < WITHIN * len(each):
        return False
    wide = abs(complex(np.ptp(u[on].real), np.ptp(u[on].imag))) >= WIDE * min(p[on, 2].min(), q[on, 2].min())
    return bool(wide and min(len(np.unique(x[on, :3], axis=0)) for x in (p, q)) >= max(consensus, SHARE * min(shown)))


def _agreeing(p: np.ndarray, q: np.ndarray, image: np.ndarray, places: np.ndarray, consensus: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of images that a transform links, proposed by a bin of scale, rotation and shift with so many of their matches (corners p, q)."""
    px, py, ps, pa = places[p].T
    qx, qy, qs, qa = places[q].T
    ratio, turn = qs / ps, qa - pa
    c, s = np.cos(turn) * ratio, np.sin(turn) * ratio
    dx, dy = qx - c * px + s * py, qy - s * px - c * py
    linked, known, first_of = [], set(), np.searchsorted(image, np.arange(image[-1] + 2))
    by_pair = np.argsort(image[p], kind="stable")  # an image is in one pair here
    pair_of = image[p][by_pair]
    for shift in (0.0, 0.5):
        half = lambda value, width: np.floor(value / width + shift).astype(np.int64)  # noqa: B023, E731
        bins = _joined([image[p], image[q], half(np.log2(ratio), 0.6), half(turn, math.pi / 6) % 12, half(dx, 12.0), half(dy, 12.0)])
        _, at = np.unique(_joined([np.unique(bins, return_inverse=True)[1], p]), return_index=True)
        _, first, votes = np.unique(bins[at], return_index=True, return_counts=True)
        order = np.argsort(bins, kind="stable")
        rich = votes >= consensus
        for one in at[first[rich]][np.argsort(-votes[rich], kind="stable")]:
            if (image[p[one]], image[q[one]]) in known:
                continue
            low, high = np.searchsorted(bins, bins[one], "left", sorter=order), np.searchsorted(bins, bins[one], "right", sorter=order)
            every = by_pair[np.searchsorted(pair_of, image[p[one]], "left") : np.searchsorted(pair_of, image[p[one]], "right")]
            some = np.flatnonzero(np.isin(every, order[low:high]))
            ours, theirs = (places[first_of[k] : first_of[k + 1]] for k in (image[p[one]], image[q[one]]))
            if _on_one_transform(places[p[every]], places[q[every]], some, ours, theirs, consensus):
                known.add((image[p[one]], image[q[one]]))
                linked.append(one)
    at = np.array(linked, np.int64)
    pairs = np.unique(np.stack([image[p[at]], image[q[at]]]), axis=1)
    return pairs[0], pairs[1]


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of corners of two images, as words of descriptors, that match: within ``NEAR`` bits, and one's nearest is the other, ties included."""
    out, least = [], np.full(len(b), NEAR, np.uint16)
    step = max(1, PAIRS // len(b))
    for i in range(0, len(a), step):
        bits = np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.uint16)
        least = np.minimum(least, bits.min(axis=0))
        own = bits == bits.min(axis=1, keepdims=True)
        x, y = np.nonzero((bits <= NEAR) & (own | (bits == least)))
        out.append(np.stack([x + i, y, bits[x, y], own[x, y]]))
    x, y, bits, own = np.concatenate(out, axis=1)
    kept = (own > 0) | (bits == least[y])  # a later block may hold a nearer one
    return x[kept], y[kept]


def _verified(pairs: DataFrame, reps: DataFrame, consensus: int) -> DataFrame:
    """Pairs (a, b) of images with a consensus."""

    def check(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                places, image, p, q, total = [], [], [], [], 0
                for r, (pa_, da, pb, db) in enumerate(zip(*(part.column(c) for c in ("pa", "da", "pb", "db")))):
                    a, b = (np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 4) for x in (da, db))
                    x, y = _near(a, b)
                    if len(np.unique(x)) < consensus or len(np.unique(y)) < consensus:
                        continue
                    places += [np.frombuffer(x_.as_buffer(), np.float32).reshape(-1, 4).astype(np.float64) for x_ in (pa_, pb)]
                    image += [np.full(len(a), 2 * r), np.full(len(b), 2 * r + 1)]
                    p.append(x + total)
                    q.append(y + total + len(a))
                    total += len(a) + len(b)
                if p:
                    first, _ = _agreeing(np.concatenate(p), np.concatenate(q), np.concatenate(image), np.concatenate(places), consensus)
                    if len(first):
                        yield part.select(["a", "b"]).take(pa.array(first // 2))

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("places").alias(f"p{c}"), F.col("descriptors").alias(f"d{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "pa", "da", "pb", "db")
    return both.mapInArrow(check, "a long, b long")


def _few(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def copies(images: DataFrame, id_: str = "image_id", image: str = "image", consensus: int = CONSENSUS) -> DataFrame:
    """One row per row of ``images``: (id, n_corners, component_id), the component named by its least id."""
    if not isinstance(images.schema[id_].dataType, (IntegralType, NullType)):
        raise TypeError(f"column {id_} isn't of whole numbers")
    scratch = Scratch(images.sparkSession, "media")
    found = scratch.table(corners(images, id_, image), "corners")
    classes = scratch.table(found.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    one = scratch.table(classes.where("rep is not null").groupBy("rep").agg(F.min("digest").alias("digest")), "one")
    reps = found.where("n > 0").withColumnRenamed("id", "rep").join(_few(one), ["rep", "digest"]).dropDuplicates(["rep"])
    reps = scratch.table(reps.select("rep", "places", "descriptors"), "reps")

    entries = _entries(reps)
    lists = entries.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("p")).where("members > 1")
    lists = scratch.table(lists.select("key", F.col("p.rep").alias("pivot")), "lists")
    shared = scratch.table(entries.join(_few(lists), "key"), "shared")
    often = lambda met, a, b: met.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("buckets")).where(F.col("buckets") >= MEET).select("a", "b")
    tested = scratch.table(often(shared.where("rep <> pivot"), "rep", "pivot"), "pairs")
    first = scratch.table(_verified(tested, reps, consensus), "first")

    stars = scratch.table(components(first, scratch, "one").withColumnRenamed("node", "rep"), "stars")
    member = scratch.table(shared.join(_few(stars), "rep", "left").select("rep", "key", F.coalesce("least", "rep").alias("least")), "member")
    torn = scratch.table(member.groupBy("key").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("key"), "torn")
    open_ = scratch.table(member.join(_few(torn), "key"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.least") != F.col("y.least")))
    across = scratch.table(often(across, "x.rep", "y.rep").join(tested, ["a", "b"], "left_anti"), "across")
    links = first.unionByName(scratch.table(_verified(across, reps, consensus), "second"))

    least = components(links, scratch, "two").withColumnRenamed("node", "rep")
    # rows of one id go together, whatever their bytes
    out = found.select("id", "digest", "n").join(classes.withColumnRenamed("rep", "same"), "digest", "left").withColumn("rep", F.coalesce("same", "id"))
    return out.join(least, "rep", "left").select(F.col("id").alias(id_), F.col("n").alias("n_corners"), F.coalesce("least", "rep").alias("component_id"))


def rendered(vector: Column, side: int = 8, zoom: int = 5) -> Column:
    """A greymap of a vector: its first ``side`` squared numbers as a square, enlarged with smooth steps."""

    @F.pandas_udf("binary")
    def render(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            if v is None or len(v) < side * side:
                out.append(None)
                continue
            a = np.asarray(v[: side * side], float).reshape(1, side, side)
            span = np.ptp(a)
            a = np.zeros_like(a) if not np.isfinite(span) or span == 0 else (a - a.min()) / span
            out.append(encode(np.rint(_resized(a, zoom)[0] * 255)))
        return pd.Series(out, dtype=object)

    return render(vector)
