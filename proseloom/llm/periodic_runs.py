"""Periodic runs of words: the same few words over and over, found in every text and collapsed.

A run is a longest stretch of words in which words one period apart are equal. By the runs
theorem (Bannai et al., "The runs theorem") each run shows itself in one of two orders of the
words, one the other's reverse: a longest Lyndon word begins in the run and has its period for
length. So a text is scanned from right to left under both orders. A stack, held as a link from
each word to the next smaller suffix, gives the longest Lyndon word at each place; its period is
extended both ways. Suffixes are compared, and periods extended, by common extensions: a binary
search over rolling hashes, whose outcome is verified word by word, each pair of words once.

A word of a run occurs at least as often as the run repeats, so a text falls into stretches of
words that are as frequent in it; each is scanned by itself. Time is about linear in the text
(a factor of its logarithm for comparisons), memory is some hundred bytes for each word of the
longest stretch. Rows are judged one by one: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proseloom.llm._tables import texts
from proseloom.llm._words import NOT_SPACE, identities, runs as stretches, word_slices

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Modulus and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class Extensions:
    """Common extensions of pairs of places in a sequence of numbers."""

    def __init__(self, words: list[int]):
        self.words, self.hashes, self.powers = words, None, None
        self.proven: dict[int, tuple[int, int]] = {}

    def _prepare(self) -> None:
        self.hashes, self.powers = [0], [1]
        h = p = 0
        p = 1
        for w in self.words:
            h, p = (h * BASE + w + 1) % PRIME, p * BASE % PRIME
            self.hashes.append(h)
            self.powers.append(p)

    def _alike(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j have one hash."""
        h, p = self.hashes, self.powers[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % PRIME == 0

    def _verified(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j are equal; what has been compared for their distance is not compared again."""
        words, apart, end = self.words, j - i, i + n
        low, high = self.proven.get(apart, (i, i))
        if end < low or i > high:
            low = high = i
        for a, b in ((i, low), (high, end)):
            if a < b and words[a:b] != words[a + apart : b + apart]:
                return False
        self.proven[apart] = (min(i, low), max(high, end))
        return True

    def _longest(self, most: int, alike) -> int:
        """The greatest n up to most for which alike holds, which holds for all smaller ones too."""
        low, step = 0, 1
        while step <= most and alike(step):
            low, step = step, 2 * step
        high = min(step, most + 1)  # alike doesn't hold for high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if alike(middle) else (low, middle)
        return low

    def ahead(self, i: int, j: int) -> int:
        """Equal words from i and from j > i on."""
        words, end = self.words, len(self.words)
        for n in range(min(3, end - j)):  # most differ at once
            if words[i + n] != words[j + n]:
                return n
        if self.hashes is None:
            self._prepare()
        n = self._longest(end - j, lambda n: self._alike(i, j, n))
        return n if self._verified(i, j, n) else next(k for k in range(n) if words[i + k] != words[j + k])

    def behind(self, i: int, j: int) -> int:
        """Equal words before i and before j > i."""
        words = self.words
        for n in range(min(3, i)):
            if words[i - 1 - n] != words[j - 1 - n]:
                return n
        if self.hashes is None:
            self._prepare()
        n = self._longest(i, lambda n: self._alike(i - n, j - n, n))
        return n if self._verified(i - n, j - n, n) else next(k for k in range(n) if words[i - 1 - k] != words[j - 1 - k])


def runs(words: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by start, then period. Equal numbers are equal words; three periods at least."""
    if least_periods < 3:
        raise ValueError("runs of under three periods may have no Lyndon root with an equal word after it")
    n, at, found = len(words), Extensions(words), set()
    for reverse in (False, True):
        smaller = [n] * n  # the next suffix that is smaller
        seen: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            a, j = words[i], i + 1
            while j < n:
                b = words[j]
                if a != b:
                    if (b < a) != reverse:
                        break
                else:
                    same = at.ahead(i, j)
                    if j + same == n or (words[j + same] < words[i + same]) != reverse:
                        break
                j = smaller[j]
            smaller[i] = j
            if j < n and words[j] == a:
                period = j - i
                start, end = seen.get(period, (n, n))
                if start <= i and j < end:
                    continue  # within a stretch of this period that was found
                start, end = i - at.behind(i, j), j + at.ahead(i, j)
                seen[period] = (start, end)
                if end - start >= max(least_words, least_periods * period):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _frequent(ids: np.ndarray, row: np.ndarray, least_words: int, times: int) -> Iterator[tuple[int, int]]:
    """Stretches of words of one row that occur as often in it."""
    key = row * (int(ids.max()) + 1) + ids
    _, own, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[own] >= times
    cuts = np.flatnonzero(np.diff(row)) + 1
    flags = np.insert(often, cuts, False)  # rows stand apart
    shift = np.searchsorted(cuts + np.arange(len(cuts)), np.arange(len(flags)))
    starts, ends = stretches(flags)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= least_words:
            yield a - int(shift[a]), b - int(shift[a])


def repeats(documents: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start and length in words, period; by start, then period) and ``text`` for each row.

    ``text`` is the words joined by one space, without those that any run holds after its first
    period: "so it goes so it goes so it goes so it goes" becomes "so it goes". Runs may overlap
    and nest; each counts. Words are maximal stretches without white space, compared unchanged.
    A null or empty text has no words, no runs and an empty text; an empty table gives no rows.
    Repeated doc_ids are judged each by its own text; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_slices(batch.column(1), NOT_SPACE):
                yield _result(batch.column(0)[lo:hi], words, least_words, least_periods)

    return texts(documents).mapInArrow(run, RESULT)


def _result(doc_ids: pa.Array, words, least_words: int, least_periods: int) -> pa.RecordBatch:
    """The rows of a slice."""
    row, first, found = words.row(), words.first, []
    if len(words):
        ids, _ = identities(words.data, words.starts, words.ends)
        for a, b in _frequent(ids, row, least_words, least_periods):
            found += [(a + s, n, p) for s, n, p in runs(ids[a:b].tolist(), least_words, least_periods)]
    start, length, period = np.array(found, np.int64).reshape(-1, 3).T
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    data, begin, end = words.joined()
    text = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            text.append("")
        elif kept[a:b].all():
            text.append(data[begin[a] : end[b - 1]].decode())
        else:
            text.append(b" ".join([data[begin[k] : end[k]] for k in (np.flatnonzero(kept[a:b]) + a).tolist()]).decode())
    own = row[start] if len(start) else start
    ends = np.searchsorted(own, np.arange(len(first))).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(start - first[own] if len(own) else start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "text"]
    )
