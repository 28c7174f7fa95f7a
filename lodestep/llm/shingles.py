"""Sets of hashed word shingles, made a few MB of text at a time."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 1 << 19
_U = np.uint64
_STEP, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, base & (1 << 64) - 1, _U))])


@functools.lru_cache(maxsize=1)
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEP, CHUNK), _powers(_INVERSE, CHUNK)


@functools.lru_cache(maxsize=4)
def _tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, its value after lower-casing A-Z, and whether it separates words."""
    lower = np.arange(256, dtype=np.int64)
    lower[65:91] += 32
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    return mix(lower.astype(_U) + _U(1)), apart


def _chunk_sets(raw: np.ndarray, bounds: np.ndarray, words: int, separators: bytes) -> Iterator[np.ndarray]:
    value, apart = _tables(separators)
    docs = len(bounds) - 1
    if not raw.size:
        yield from (np.empty(0, np.int64) for _ in range(docs))
        return
    power, inverse = _chunk_powers() if raw.size <= CHUNK else (_powers(_STEP, raw.size), _powers(_INVERSE, raw.size))
    gap = apart[raw]
    first = np.zeros(raw.size + 1, bool)
    first[bounds] = True  # texts end words too
    starts = np.flatnonzero(~gap & (first[:-1] | np.concatenate([[True], gap[:-1]])))
    ends = np.flatnonzero(~gap & (first[1:] | np.concatenate([gap[1:], [True]]))) + 1
    total = np.concatenate([np.zeros(1, _U), np.cumsum(value[raw] * power[: raw.size])])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    at = np.searchsorted(starts, bounds)  # first word of each text
    joined = word.copy()
    for i in range(1, words):
        n = max(0, len(word) - i)
        joined[:n] = mix(joined[:n] * _U(_STEP) + word[i:])
    for d in range(docs):
        a, b = at[d], at[d + 1]
        if b - a >= words:
            yield np.unique((joined[a : b - words + 1] >> _U(1)).astype(np.int64))
        elif b > a:
            one = word[a : a + 1].copy()
            for w in word[a + 1 : b]:
                one = mix(one * _U(_STEP) + w)
            yield (mix(one + _U(b - a)) >> _U(1)).astype(np.int64)
        else:
            yield np.empty(0, np.int64)


def sets(texts: pa.Array, words: int, separators: bytes) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (63 bits) of its shingles of ``words`` words.

    A text of fewer words has one shingle, all of them; one without words, or null, has none.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        yield from _chunk_sets(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words, separators)
        i = j


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
