"""Exact substring deduplication across documents, by seed and extend.

Seeds are winnowed anchors: of the word k-grams in each window of ``length`` words, the one
with the smallest hash. Equal windows have equal seeds, so documents need only be joined on
seeds. A stretch of windows with one seed is a run, and a match is extended from its seed
both ways: first over the whole run (runs with equal words form a class, whose smallest
doc_id stands for all its members), then, only where a seed has several classes, window by
window between one run of each class. Words are compared by 128-bit digests of their bytes;
the rolling hashes only choose seeds. Covered windows that touch or overlap are joined to
maximal repeats.

Classes take the place of pairs: a group of n copies costs n rows in each step, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm._tables import texts, written
from proseloom.llm._words import NOT_SPACE, Prefix, Words, digests, part, runs, word_slices


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by doubling."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _keyed(documents: DataFrame) -> DataFrame:
    """``doc_id, part, text``: rows that share a doc_id are told apart by ``part``."""
    return texts(documents).select("doc_id", part(F.col("text")).alias("part"), "text")


def _windows(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray] | None:
    """First words of all windows that lie in one row, and their seeds."""
    if len(words) < length:
        return None
    prefix = Prefix(words.hashes())
    at = np.arange(len(words) - gram + 1)
    seeds = _smallest(prefix.of(at, at + gram), length - gram + 1)
    row = words.row()
    start = np.flatnonzero(row[: len(seeds)] == row[length - 1 :])
    return (start, seeds[start]) if len(start) else None


def _runs(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, part, seed, h1, h2`` (digest of all words of the run), ``first`` (word), ``n`` (windows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for lo, _, words in word_slices(batch.column(2), NOT_SPACE):
                if (found := _windows(words, length, gram)) is None:
                    continue
                start, seeds = found
                new = np.ones(len(start), bool)
                new[1:] = (seeds[1:] != seeds[:-1]) | (start[1:] != start[:-1] + 1)
                new[1:] |= words.row()[start[1:]] != words.row()[start[:-1]]
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(start)))
                first = start[head]
                row = words.row()[first]
                data, starts, ends = words.joined()
                digest = digests(data, starts[first], ends[first + n + length - 2])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo + row]),
                        pa.array(parts[lo + row]),
                        pa.array(seeds[head].view(np.int64)),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array((first - words.first[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["doc_id", "part", "seed", "h1", "h2", "first", "n"],
                )

    return _keyed(documents).where(F.length("text") >= 2 * length - 1).mapInArrow(cut, "doc_id long, part long, seed long, h1 long, h2 long, first int, n int")


def _extended(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The windows of the wanted runs (``doc_id, part, runs: array<struct<h1, h2, first, n>>``): ``h1, h2, doc_id, at, k1, k2`` (digest of the window)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wants = batch.column(2)
            for lo, hi, words in word_slices(batch.column(1), NOT_SPACE):
                own = wants.slice(lo, hi - lo)
                flat = own.flatten()
                if not len(flat):
                    continue
                row = np.repeat(np.arange(hi - lo), np.diff(own.offsets.to_numpy()))
                h1, h2, first, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                n = n.astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = words.first[row][of] + first[of] + at
                data, starts, ends = words.joined()
                digest = digests(data, starts[start], ends[start + length - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[of]), pa.array(h2[of]), pa.array(ids[lo + row[of]]), pa.array(at.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                    ["h1", "h2", "doc_id", "at", "k1", "k2"],
                )

    joined = _keyed(documents).join(wanted, ["doc_id", "part"]).select("doc_id", "text", "runs")
    return joined.mapInArrow(keyed, "h1 long, h2 long, doc_id long, at int, k1 long, k2 long")


def repeats(documents: DataFrame, length: int = 50, gram: int = 10) -> DataFrame:
    """Stretches of windows seen in an earlier document: ``doc_id, part`` (of the text), ``first`` (word), ``n`` (windows); they may touch and overlap.

    A window is ``length`` consecutive words (`[^\\x20\\x09-\\x0D]+`); it is seen earlier if
    its word sequence also starts in a row with a smaller doc_id. Rows that repeat a doc_id
    are judged each on its own text and do not make each other's windows seen. Null, empty and
    short texts have no windows; rows without a doc_id take no part.
    """
    found = written(_runs(documents.where("doc_id is not null"), length, gram), "runs")
    seeds = written(found.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed"), "shared-seeds")
    shared = written(found.join(seeds, "seed"), "shared-runs")
    classes = written(shared.groupBy("seed", "h1", "h2").agg(F.min(F.struct("doc_id", "part", "first", "n")).alias("run")), "classes")
    several = written(classes.groupBy("seed").agg(F.count("*").alias("m")).where("m > 1").select("seed"), "open-seeds")
    wanted = (
        classes.join(several, "seed")
        .groupBy(F.col("run.doc_id").alias("doc_id"), F.col("run.part").alias("part"))
        .agg(F.collect_list(F.struct("h1", "h2", F.col("run.first").alias("first"), F.col("run.n").alias("n"))).alias("runs"))
    )
    windows = written(_extended(documents, wanted, length), "windows")
    earliest = written(windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "earliest-windows")
    seen = windows.join(earliest, ["k1", "k2"]).where("doc_id > low").select("h1", "h2", "at")
    partial = written(seen.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("at")).alias("ats")), "partial-classes")
    members = shared.select("doc_id", "part", "h1", "h2", "first", "n").join(classes.select("h1", "h2", F.col("run.doc_id").alias("low")), ["h1", "h2"])
    whole = members.where("doc_id > low").select("doc_id", "part", "first", "n")
    rest = members.where("doc_id = low").join(partial, ["h1", "h2"]).select("doc_id", "part", "first", F.explode("ats").alias("at")).selectExpr("doc_id", "part", "first + at AS first", "1 AS n")
    return whole.union(rest)


def deduplicated(documents: DataFrame, length: int = 50, gram: int = 10) -> DataFrame:
    """Per document: ``doc_id, text`` (kept words joined by one space), ``n_words``, ``n_removed`` (longs), ``spans`` (removed ranges of word numbers: maximal repeats).

    Words covered by a window seen in a document with a smaller doc_id go, judged on the
    input. Null and empty texts give an empty text; other columns are not read. Rows that
    repeat a doc_id stay, each cut by itself; rows without one lose nothing.
    """
    by_doc = repeats(documents, length, gram).groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "n")).alias("found"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed, spans = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if found.is_valid and len(found.values):
                    first, n = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.minimum(first + n + length - 1, len(words)), -1)
                starts, ends = (x.tolist() for x in runs(np.cumsum(gone)[:-1] > 0))
                keep, at = [], 0
                for a, b in zip(starts, ends, strict=True):
                    keep += words[at:a]
                    at = b
                keep += words[at:]
                kept.append(b" ".join(keep).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                spans.append([{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)],
                ["doc_id", "text", "n_words", "n_removed", "spans"],
            )

    joined = _keyed(documents).join(by_doc, ["doc_id", "part"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")
