"""Vectorised byte kernels shared by the text operators.

Everything works on one document at a time as a ``uint8`` array, so memory is
bounded by the longest document of an Arrow batch, never by a group of rows.
Substring fingerprints (``span_hash``) are polynomial prefix sums modulo 2**64 with fixed
byte codes: equal strings always get equal fingerprints, but different ones can be made that
share one, so they serve as features and filters only. Where a result rests on equality,
``Keyed`` fingerprints are taken: the chance that two different strings share one is bounded
for every pair of strings, as long as these do not depend on the job's random key.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i < n (cached, grown by doubling)."""
    if _powers["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the substrings [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    edge = np.zeros(len(buf) + 2, np.int8)
    edge[1:-1] = ~SPACE[buf]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Keyed:
    """Fingerprints by multilinear hashing modulo 2**64 under a random key.

    A string's bytes, each plus one, are weighted by random numbers of their places and
    summed; the top 56 bits of such sums are strongly universal: any two different strings
    share them with probability 2**-56. Runs of items are weighted by halves of 32 bits,
    twice, which leaves 2 * 32 such bits. All jobs' tasks make the same numbers from the
    key; a job draws its own (``new_key``)."""

    def __init__(self, key: bytes):
        number = int.from_bytes(key, "little") << 1
        self.draw = np.random.Philox(key=number & (1 << 128) - 1)
        self.runs = np.random.Philox(key=(number | 1) & (1 << 128) - 1).random_raw(4 * 64).reshape(2, 128)
        self.places = self.draw.random_raw(1 << 12)

    def spans(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the non-empty substrings [start, end), which do not overlap."""
        if not len(start):
            return np.zeros(0, np.uint64)
        size = end - start
        while len(self.places) < (longest := int(size.max())):
            self.places = np.concatenate((self.places, self.draw.random_raw(max(len(self.places), longest - len(self.places)))))
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        place = step - np.repeat(first, size)
        byte = buf[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
        return np.add.reduceat(self.places[place] * byte, first) >> np.uint64(8)

    def words(self, buf: np.ndarray) -> np.ndarray:
        return self.spans(buf, *word_spans(buf))

    def windows(self, items: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of all runs of ``width`` consecutive items, 64 at most."""
        n = len(items) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        low, high = items & np.uint64(0xFFFFFFFF), items >> np.uint64(32)
        out = []
        for weights in self.runs:
            total = np.full(n, weights[127], np.uint64)
            for k in range(width):
                total += weights[2 * k] * low[k : k + n] + weights[2 * k + 1] * high[k : k + n]
            out.append(total >> np.uint64(32))
        return out[0] << np.uint64(32) | out[1]


def new_key() -> bytes:
    return os.urandom(15)


@functools.cache
def keyed(key: bytes) -> Keyed:
    return Keyed(key)


def byte_rows(column: pa.Array):
    """The rows of a string or binary column as ``uint8`` views; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(n):
        yield raw[:0] if nulls is not None and nulls[i] else raw[at[i] : at[i + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
