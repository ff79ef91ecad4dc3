from __future__ import annotations

import re

import numpy as np
import xxhash

from proseloom.llm import simhash


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict[int, int], budget: int) -> dict[int, int]:
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= budget and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_matches_brute_force(unique):
    found = {r.doc_id: r for r in simhash.near_duplicates(unique).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in unique.collect()}
    assert {i: r.fingerprint & (1 << 64) - 1 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute_components(prints, 2)


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    flips = [base]
    for _ in range(3):
        flips.append(base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    values = np.unique(np.concatenate(flips))
    for budget in (0, 1, 2, 3):
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= budget}
        assert {(int(a), int(b)) for x, y in simhash.walk(values, None, 0, budget) for a, b in zip(x, y, strict=True)} == want
        half = len(values) // 2
        crossed = {(int(a), int(b) + half) for x, y in simhash.walk(values[:half], values[half:], 0, budget) for a, b in zip(x, y, strict=True)}
        assert crossed == {(i, j) for i, j in want if i < half <= j}


def test_chains_and_dense_groups(spark):
    """A chain of one-bit steps is one component; so is a dense ball of fingerprints."""
    chain = [(i, (1 << i) - 1) for i in range(40)]
    ball = [(1000 + k, (0xABCD << 44) ^ (1 << (k % 40)) ^ (1 << (k // 40))) for k in range(400)]
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in chain + ball], "id long, fingerprint long").dropDuplicates(["fingerprint"])
    from proseloom.operators.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame, 2)).collect()}
    assert {roots.get(i, i) for i, _ in chain if i in roots} == {0}
    assert len({r for n, r in roots.items() if n >= 1000}) == 1


def test_crowded_nodes_are_split(spark):
    """Fingerprints that share most bits fill one node; with nodes of a few rows the links are the same."""
    rng = np.random.default_rng(5)
    near = np.uint64(0x5A5A << 40) ^ rng.integers(0, 1 << 12, 700, np.uint64)
    far = rng.integers(0, 1 << 63, 200, np.uint64)
    values = np.unique(np.concatenate((near, far, far ^ np.uint64(3 << 20))))
    frame = spark.createDataFrame([(i, int(f.view(np.int64))) for i, f in enumerate(values)], "id long, fingerprint long")
    from proseloom.operators.components import components

    want = brute_components({i: int(f) for i, f in enumerate(values)}, 2)
    for node_rows in (8, 1 << 16):
        roots = {r.node: r.root for r in components(simhash.links(frame, 2, node_rows)).collect()}
        assert {i: roots.get(i, i) for i in range(len(values))} == want


def test_rows_without_ids(spark):
    rows = [(None, "a b c d"), (2**60 + 1, "a b c d"), (2**60 + 3, "a b c d"), (None, "quite another text of words"), (5, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 2**60 + 1), (5, 5), (2**60 + 1, 2**60 + 1), (2**60 + 3, 2**60 + 1)]


def test_empty_and_repeated(empty, documents):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(documents).count() == documents.count()
