"""Benchmark decontamination: Wu-Manber multi-pattern search with words as symbols.

Every window of benchmark words is a pattern. Patterns of one length share a shift table
over blocks of two words: where the block under the cursor ends no pattern soon, the cursor
skips ahead (by up to the pattern length less one); where the shift is 0, the block's bucket of
patterns is compared, first by word hashes and then by the bytes themselves. The cursors of
many stretches of text move together as one numpy array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm._tables import texts, written
from proseloom.llm._words import ALPHANUMERIC, Words, digests, mixed, part, runs, utf8, word_slices

#: Characters of benchmark text that are searched for in one pass over the documents (their tables take some 40 bytes a character).
BLOCK_CHARS = 4 << 20
_LANE = 256
_SLOT_BITS = 18


def _blocks(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9FB21C651E98DF25) ^ last)


class Searcher:
    """The tables for patterns of ``length`` words each.

    hashes: of all words of the items; at: each pattern's first word there; data, starts, ends:
    the items' words joined, and where each word stands; owners: for pattern p the items
    ``owners[owned[p]:owned[p + 1]]``.
    """

    def __init__(self, length: int, at: np.ndarray, owned: np.ndarray, owners: np.ndarray, hashes: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray):
        self.length, self.hashes, self.data, self.starts, self.ends = length, hashes, data, starts, ends
        self.span = min(2, length)
        block = [self._block(at + q) for q in range(self.span - 1, length)]
        order = np.argsort(block[-1], kind="stable")
        self.at, self.suffix = at[order], block[-1][order]
        self.first, self.last, self.owners = owned[:-1][order], owned[1:][order], owners
        self.shift = np.full(1 << _SLOT_BITS, length - self.span + 1, np.int64)
        for q, value in zip(range(self.span - 1, length), block, strict=True):
            np.minimum.at(self.shift, (value >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), length - 1 - q)

    def _block(self, last: np.ndarray) -> np.ndarray:
        return _blocks(self.hashes[last - 1], self.hashes[last]) if self.span == 2 else self.hashes[last]

    def _candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions of possible windows and the blocks that end there."""
        n, m = len(words), self.length
        starts = np.arange(m - 1, n, _LANE)
        cursor, stop = starts, np.minimum(starts + _LANE, n)
        at, blocks = [], []
        while len(cursor):
            value = _blocks(words[cursor - 1], words[cursor]) if self.span == 2 else words[cursor]
            skip = self.shift[(value >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
            hit = skip == 0
            if hit.any():
                at.append(cursor[hit])
                blocks.append(value[hit])
            cursor = cursor + np.maximum(skip, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *at]), np.concatenate([none.astype(np.uint64), *blocks])

    def find(self, words: Words, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """First word and pattern of each occurrence that lies in one row."""
        at, value = self._candidates(hashes)
        start = at - self.length + 1
        lo, hi = np.searchsorted(self.suffix, value, "left"), np.searchsorted(self.suffix, value, "right")
        keep = (hi > lo) & (row[start] == row[at]) if len(at) else np.zeros(0, bool)
        start, lo, n = start[keep], lo[keep], (hi - lo)[keep]
        of = np.repeat(np.arange(len(n)), n)
        pattern = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start = start[of]
        same = np.ones(len(of), bool)
        for q in range(self.length):
            same &= hashes[start + q] == self.hashes[self.at[pattern] + q]
        start, pattern = start[same], pattern[same]
        if not len(start):
            return
        data, starts, ends = words.joined()
        mine = zip(starts[start].tolist(), ends[start + self.length - 1].tolist(), strict=True)
        theirs = zip(self.starts[self.at[pattern]].tolist(), self.ends[self.at[pattern] + self.length - 1].tolist(), strict=True)
        for i, p, (a, b), (c, d) in zip(start.tolist(), pattern.tolist(), mine, theirs, strict=True):
            if data[a:b] == self.data[c:d]:
                yield i, p

    def items(self, pattern: int) -> list[int]:
        return self.owners[self.first[pattern] : self.last[pattern]].tolist()


def searchers(items: list[tuple[str, str]], window: int) -> tuple[list[str], list[Searcher]]:
    """The distinct item ids, and Wu-Manber tables for all windows of the items (id, text), one for each pattern length."""
    names, number = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
    words = Words(*utf8(pa.array([t for _, t in items], pa.string())), ALPHANUMERIC, lower=True)
    hashes, (data, starts, ends) = words.hashes(), words.joined()
    size = np.diff(words.first)
    length = np.minimum(size, window)
    found = []
    for n in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == n)
        count = size[own] - n + 1
        of = np.repeat(own, count)
        at = words.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        digest = digests(data, starts[at], ends[at + n - 1])
        _, where, pattern = np.unique(np.ascontiguousarray(digest).view("V16").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((pattern, number[of]), 1), axis=0)
        owned = np.searchsorted(pairs[:, 0], np.arange(len(where) + 1))
        found.append(Searcher(n, at[where], owned, pairs[:, 1], hashes, data, starts, ends))
    return names.tolist(), found


def _scan(documents: DataFrame, names: list[str], found: list[Searcher], *keys: str):
    """``doc_id``, the keys, ``n_words, hits, item_ids`` of each row, and the broadcast tables."""
    tables = documents.sparkSession.sparkContext.broadcast((names, found))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = tables.value
        for batch in batches:
            n_words: list[int] = []
            hits: list[list[dict]] = []
            owners: list[list[str]] = []
            for lo, hi, words in word_slices(batch.column(1), ALPHANUMERIC, lower=True):
                counts = np.diff(words.first)
                rows: list[list[dict]] = [[] for _ in range(lo, hi)]
                seen: list[set[int]] = [set() for _ in range(lo, hi)]
                if len(words) and found:
                    row, hashes = words.row(), words.hashes()
                    covered = np.zeros(len(words) + 1, np.int64)
                    for one in found:
                        for i, p in one.find(words, hashes, row):
                            covered[i] += 1
                            covered[i + one.length] -= 1
                            seen[row[i]].update(one.items(p))
                    hit = np.cumsum(covered[:-1]) > 0
                    for r in np.unique(row[hit]).tolist():
                        first = words.first[r]
                        rows[r] = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(hit[first : words.first[r + 1]])), strict=True)]
                n_words += counts.tolist()
                hits += rows
                owners += [[names[i] for i in sorted(x)] for x in seen]
            own = [batch.column(0), *(batch.column(2 + k) for k in range(len(keys))), pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(owners, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", *keys, "n_words", "hits", "item_ids"])

    schema = "doc_id long, " + "".join(f"{k} long, " for k in keys) + "n_words long, hits array<struct<start:int,end:int>>, item_ids array<string>"
    return documents.mapInArrow(searched, schema), tables


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of documents: ``doc_id, n_words, n_hit`` (longs), ``hits`` (ranges of word numbers), ``item_ids`` (strings, of items that occur), ``contaminated``.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is
    ``window`` consecutive words of an item; a shorter item is one window; null and empty items
    and items without an id have none; null and empty documents have no words. Rows that repeat
    an item_id are one item with the windows of all; rows that repeat a doc_id, or have none,
    are judged each on its own text.

    The benchmark is searched for in blocks of about ``block_chars`` characters (one item at
    least), each one pass over the documents that keeps the rows with hits; the results are the
    same for any number of blocks, but that hits of several blocks may overlap.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    size = F.aggregate("hits", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    if blocks == 1:
        found, _ = _scan(texts(documents), *searchers(sorted((r["item_id"], r["text"]) for r in items.collect()), window))
    else:
        keyed = texts(documents).select("doc_id", "text", part(F.col("text")).alias("part"))
        passes = []
        for b in range(blocks):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            scan, tables = _scan(keyed, *searchers(sorted((r["item_id"], r["text"]) for r in own.collect()), window), "part")
            passes.append(written(scan.where("size(hits) > 0").dropDuplicates(["doc_id", "part"]), "block-hits"))
            tables.destroy()
        every = passes[0]
        for one in passes[1:]:
            every = every.unionByName(one)
        hits = every.groupBy(F.col("doc_id").alias("hit_doc"), F.col("part").alias("hit_part")).agg(  # one row a block at most
            F.flatten(F.collect_list("hits")).alias("hit_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("hit_items")
        )
        counted, _ = _scan(keyed, [], [], "part")
        joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("part") == F.col("hit_part")), "left")
        found = joined.select("doc_id", "n_words", F.coalesce("hit_ranges", "hits").alias("hits"), F.coalesce("hit_items", "item_ids").alias("item_ids"))
        size = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["end"] - 1)))))
    return found.select("doc_id", "n_words", size.cast("long").alias("n_hit"), "hits", "item_ids", (F.size("hits") > 0).alias("contaminated"))
