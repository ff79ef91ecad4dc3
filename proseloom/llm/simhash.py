"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join.

Distinct fingerprints are sorted into a binary trie. Pairs of its nodes are walked
together: a pair of nodes carries the bits in which its two prefixes differ so far, and is
dropped as soon as these exceed the error budget. The top of the trie is walked by Spark: rows
are dealt to their pairs of nodes, and pairs that hold too many rows are split further, a few
bits at a time. Below it each task walks its own pairs breadth first, as numpy arrays.

A fingerprint has at most ``sum(C(64, k), k <= budget)`` different neighbours, so the links
between distinct fingerprints stay linear in their number; copies share one fingerprint and
are never paired.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm._tables import texts, written
from proseloom.llm._words import slices, utf8
from proseloom.operators.components import components

BITS = 64
#: Bits of the trie by which rows are dealt at first (fewest, most), rows of a pair of nodes beyond which it is split further, and by how many bits.
TOP_BITS, MOST_TOP_BITS, NODE_ROWS, STEP_BITS = 6, 14, 1 << 16, 4
#: Node pairs walked at once in a task.
FRONTIER = 1 << 19


def _shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip((ends - lengths)[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the bits set in over half of its hashes; 0 for a row without any."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    sums = np.zeros((len(counts), BITS), np.int64)
    step = 1 << 16
    for lo in range(0, len(hashes), step):  # so that a single long text needs no more memory
        bits = np.unpackbits(hashes[lo : lo + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        here = rows[(ends[rows] > lo) & (ends[rows] - counts[rows] < lo + step)]
        starts = np.maximum(ends[here] - counts[here] - lo, 0)
        sums[here] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    packed = np.packbits(2 * sums > counts[:, None], axis=1)
    out[rows] = packed.view(">u8").reshape(-1)[rows]
    return out


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint`` (long) of every text.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; shingles are ``words`` words
    joined by a space, repeats included; a shorter text is one shingle; a text without words,
    null included, has fingerprint 0. Only ``doc_id`` and ``text`` are read.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = []
            for lo, hi in slices(offsets):
                each = [_shingle_hashes(data[offsets[i] : offsets[i + 1]].tobytes(), words, seed) for i in range(lo, hi)]
                counts = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((h for one in each for h in one), np.uint64, int(counts.sum()))
                parts.append(_majority(flat, counts))
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return texts(documents).mapInArrow(hashed, "doc_id long, fingerprint long")


def _permuted(values: np.ndarray, order: list[int]) -> np.ndarray:
    """The same values with bit ``order[0]`` first (as the most significant), and so on."""
    out = np.zeros(len(values), np.uint64)
    for at, bit in enumerate(order):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(BITS - 1 - at)
    return out


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where each node (a range of sorted values that share ``depth`` bits) has its first value with the next bit set."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    keep = ~np.uint64(0) << np.uint64(BITS - depth) if depth else np.uint64(0)
    first = values[np.minimum(lo, len(values) - 1)]
    return np.clip(np.searchsorted(values, (first & keep) | bit), lo, hi)


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted ``a`` and ``b`` (None: of ``a`` with itself, each pair once) that differ in at most ``budget`` of the bits from ``depth`` on."""
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(budget))]
    while stack:
        depth, alo, ahi, blo, bhi, left = stack.pop()
        if len(alo) > FRONTIER and depth < BITS:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, left))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, left)))]
            continue
        small = (ahi - alo) * (bhi - blo) <= 8 if depth < BITS else np.ones(len(alo), bool)
        if small.any():
            la, lb = alo[small], blo[small]
            width = (bhi - blo)[small]
            n = (ahi - alo)[small] * width
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i, j = la[of] + k // width[of], lb[of] + k % width[of]
            near = np.bitwise_count(_below(a[i] ^ b[j], depth)) <= left[small][of]
            if alone:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, left = (x[~small] for x in (alo, ahi, blo, bhi, left))
        if not len(alo):
            continue
        am, bm = _split(a, alo, ahi, depth), _split(b, blo, bhi, depth)
        parts = [(alo, am, blo, bm, left), (am, ahi, bm, bhi, left), (alo, am, bm, bhi, left - 1)]
        own = (alo == blo) & (ahi == bhi) if alone else np.zeros(len(alo), bool)  # a node with itself: its two halves meet once
        parts.append(tuple(x[~own] for x in (am, ahi, blo, bm, left - 1)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        alive = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] >= 0)
        if alive.any():
            stack.append((depth + 1, *(x[alive] for x in joined)))


def _below(x: np.ndarray, depth: int) -> np.ndarray:
    return x & (~np.uint64(0) >> np.uint64(depth)) if depth < BITS else np.zeros(len(x), np.uint64)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n can reach over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            if (label == before).all() and (label[i] == label[j]).all():
                break
    while (label[label] != label).any():
        label = label[label]
    return label


def _masks(bits: int, budget: int) -> list[int]:
    """The ways in which two nodes may differ in their last ``bits`` bits, within the budget."""
    return sorted(sum(1 << x for x in some) for k in range(min(budget, bits) + 1) for some in itertools.combinations(range(bits), k))


def _node(order: list[int], lo: int, hi: int) -> Column:
    """Bits ``order[lo:hi]`` of the fingerprint as one number."""
    return sum((F.shiftleft(F.shiftrightunsigned("fingerprint", bit).bitwiseAND(F.lit(1)), hi - lo - 1 - at) for at, bit in enumerate(order[lo:hi])), F.lit(0).cast("long"))


def _dealt(rows: DataFrame, order: list[int], lo: int, hi: int, budget: int) -> DataFrame:
    """Rows (``fingerprint, id, node, mask``: node at depth lo, and its difference to the other of the pair) dealt to all pairs of nodes at depth hi that may hold links: with ``low`` (the lesser node) and ``high`` (of the greater)."""
    ways = F.array(*(F.struct(F.lit(m).cast("long").alias("more"), F.lit(m.bit_count()).alias("cost")) for m in _masks(hi - lo, budget)))
    deeper = rows.select("fingerprint", "id", (F.shiftleft("node", hi - lo) + _node(order, lo, hi)).alias("node"), "mask", F.explode(ways).alias("way"))
    alive = deeper.where(F.bit_count("mask") + F.col("way.cost") <= budget)
    found = alive.select("fingerprint", "id", "node", (F.shiftleft("mask", hi - lo) + F.col("way.more")).alias("mask"))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    return found.select("fingerprint", "id", "node", "mask", F.least("node", other).alias("low"), (F.col("node") > other).alias("high"))


def links(distinct: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """``u, v`` (u > v): ids of linked distinct fingerprints, for each node pair of the trie a spanning forest of its links.

    distinct: ``fingerprint`` and an ``id`` (long, not null) of each; the links' transitive
    closure is exactly that of "differs in at most ``budget`` bits". No pair of nodes with
    more than ``node_rows`` fingerprints goes to one task, however alike they are.
    """
    ones = distinct.agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fingerprint", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS))).first()
    n = ones["n"]
    order = sorted(range(BITS), key=lambda b: (abs((ones[f"b{b}"] or 0) / max(n, 1) - 0.5), b))
    depth = min(MOST_TOP_BITS, max(TOP_BITS, math.ceil(math.log2(max(n, 1) / node_rows))))
    root = distinct.select("fingerprint", "id", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("mask"))
    rows = _dealt(root, order, 0, depth, budget)
    parts = []
    while True:
        crowded = rows.groupBy("low", "mask").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).select("low", "mask")
        crowded = written(crowded, "crowded-nodes") if depth + STEP_BITS < BITS - 1 else crowded.limit(0)
        if crowded.isEmpty():
            parts.append(_walked(rows, order, depth, budget))
            break
        parts.append(_walked(rows.join(crowded, ["low", "mask"], "left_anti"), order, depth, budget))
        rows = written(_dealt(rows.join(crowded, ["low", "mask"]), order, depth, depth + STEP_BITS, budget), "split-nodes")
        depth += STEP_BITS
    found = parts[0]
    for one in parts[1:]:
        found = found.union(one)
    return found


def _walked(rows: DataFrame, order: list[int], top: int, budget: int) -> DataFrame:
    """The links of each pair of nodes at depth ``top``, as a forest: ``u, v``."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(low: int, mask: int, group: np.ndarray) -> pa.RecordBatch | None:
            values = _permuted(group["f"].view(np.uint64), order)
            side = group["high"]
            a, b = np.flatnonzero(~side), np.flatnonzero(side)
            a, b = a[np.argsort(values[a])], b[np.argsort(values[b])]
            if not mask:
                found = walk(values[a], None, top, budget)
                ids = group["id"][a]
            elif len(a) and len(b):
                found = ((i, j + len(a)) for i, j in walk(values[a], values[b], top, budget - mask.bit_count()))
                ids = np.concatenate((group["id"][a], group["id"][b]))
            else:
                return None
            by_id = np.argsort(ids)
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            label = _forest(len(ids), ((rank[i], rank[j]) for i, j in found))
            far = np.flatnonzero(label != np.arange(len(ids)))
            ids = ids[by_id]
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["u", "v"]) if len(far) else None

        kept: list[np.ndarray] = []
        key: tuple[int, int] | None = None
        kind = np.dtype([("f", np.int64), ("id", np.int64), ("high", bool)])
        for batch in batches:
            if not batch.num_rows:
                continue
            low, mask = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("low", "mask"))
            rows = np.empty(len(low), kind)
            for name, column in (("f", "fingerprint"), ("id", "id"), ("high", "high")):
                rows[name] = batch.column(column).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(low) != 0) | (np.diff(mask) != 0)) + 1).tolist(), len(low)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if key is not None and key != (low[x], mask[x]):
                    if out := pairs(*map(int, key), np.concatenate(kept)):
                        yield out
                    kept = []
                key = (low[x], mask[x])
                kept.append(rows[x:y])
        if key is not None and (out := pairs(*map(int, key), np.concatenate(kept))):
            yield out

    keyed = rows.select("fingerprint", "id", "low", "mask", "high")
    return keyed.repartition("low", "mask").sortWithinPartitions("low", "mask").mapInArrow(walked, "u long, v long")


def near_duplicates(documents: DataFrame, words: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (long), ``component_id`` (smallest reachable doc_id, itself included).

    Texts without words share fingerprint 0 and so one component. Rows that repeat a doc_id
    are kept as they are. Rows without a doc_id link nothing; their component_id is that of rows
    with the same fingerprint, null if there are none. An empty table gives an empty result.
    """
    prints = written(fingerprints(documents, words, seed), "fingerprints")
    distinct = written(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    found = components(links(distinct, budget))
    roots = written(distinct.join(found, distinct["id"] == found["node"], "left").select("fingerprint", F.coalesce("root", "id").alias("component_id")), "fingerprint-components")
    return prints.join(roots, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")
