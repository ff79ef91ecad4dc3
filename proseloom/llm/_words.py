"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Everything here works on one slice of a batch inside a task; slices are cut by bytes, so
the memory of a task doesn't depend on how long texts are, save for a single longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Odd, so that it has an inverse modulo 2**64 and hashes of slices come from prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20

ASCII_SPACES = np.zeros(256, bool)
ASCII_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~ASCII_SPACES
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any slices of a sequence of 64-bit values, in constant time for each.

    They choose candidates only: structured sequences can share a hash, so where equality
    decides a result, bytes or ``digests`` are compared.
    """

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power(_BASE, len(values)), out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of a slice of rows: byte ranges in ``data``, and for row i the words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = False):
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        if lower:
            self.data = LOWER[self.data]
        rows = offsets - base
        inside = is_word[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = rows[(rows > 0) & (rows < n)]
        before[cuts], after[cuts - 1] = False, False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, rows)

    def __len__(self) -> int:
        return len(self.starts)

    def prefix(self) -> Prefix:
        return Prefix(self.data.astype(np.uint64) + np.uint64(1))

    def hashes(self) -> np.ndarray:
        return self.prefix().of(self.starts, self.ends)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space between them, and where each starts and ends there."""
        length = self.ends - self.starts
        ends = np.cumsum(length + 1) - 1
        out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = self.data[self.inside]
        return out.tobytes(), ends - length, ends

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests of stretches of ``data``, as two longs each: equal only if the stretches are."""
    made = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, "<i8").reshape(-1, 2)


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each stretch of ``data``, equal if and only if their bytes are, and the place of one stretch for each number."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = Prefix(data.astype(np.uint64) + np.uint64(1)).of(starts, ends)
    _, sample, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    other = sample[ids]
    same = (size == size[other]).all()
    if same:
        ahead = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = (data[np.repeat(starts, size) + ahead] == data[np.repeat(starts[other], size) + ahead]).all()
    if same:
        return ids, sample
    text, known = data.tobytes(), {}  # two stretches share a hash
    spelled = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    ids = np.array([known.setdefault(w, len(known)) for w in spelled])
    return ids, np.unique(ids, return_index=True)[1]


def part(text: Column) -> Column:
    """A long that tells texts apart which share a doc_id."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_slices(column: pa.Array, is_word: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, Words(data, offsets[lo : hi + 1], is_word, lower)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: ``counts[i]`` of the values for row i."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
