"""Substring deduplication and decontamination against plain double loops."""

from __future__ import annotations

import re

from proseloom.llm import decontaminate, substring_dedup


def brute_repeats(rows: list[tuple], length: int) -> dict:
    first: dict[tuple, int] = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone))
    return out


def test_repeats_match_brute_force(unique):
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    for length, gram in ((50, 10), (12, 4), (5, 5)):
        found = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(unique, length, gram).collect()}
        assert found == brute_repeats(rows, length)


def test_spans_are_maximal(unique):
    for r in substring_dedup.deduplicated(unique).where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert all(s.end - s.start >= 50 for s in r.spans)


def test_empty_table(empty, spark):
    assert substring_dedup.deduplicated(empty).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows: list[tuple], items: list[tuple], window: int) -> dict:
    patterns = []
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        n = min(window, len(w))
        patterns += [(str(i), w[k : k + n]) for k in range(len(w) - n + 1)] if n and i is not None else []
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        hit, seen = set(), set()
        for item, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    seen.add(item)
        out[i] = (len(w), len(hit), seen)
    return out


def test_decontamination_matches_brute_force(unique, spark):
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    texts = dict(rows)
    items = [(1, " ".join(texts[5].split()[100:130])), (2, texts[100].upper()), (3, "so so so"), (4, None), (5, ""), (None, "only three"), (7, "three WORDS"), (8, texts[6]), (9, texts[6]), (10, "für-größe, für")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items, 10)
    for chars in (1 << 20, 300):  # one block, several blocks
        found = {r.doc_id: (r.n_words, r.n_hit, set(r.item_ids)) for r in decontaminate.contamination(unique, benchmark, block_chars=chars).collect()}
        assert found == want


def thue_morse(a: str, b: str, doublings: int = 10) -> str:
    """A word and its complement share every polynomial hash modulo a power of two."""
    out, other = a, b
    for _ in range(doublings):
        out, other = out + other, other + out
    return out


def test_words_that_collide_are_told_apart(spark):
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*rest[:30], thue_morse("a", "b"), *rest[30:]])), (2, " ".join([*rest[:30], thue_morse("b", "a"), *rest[30:]]))]
    found = {r.doc_id: r.n_removed for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 0}


def test_repeated_ids(documents, spark):
    """Rows that share a doc_id are cut each by its own text, shorter ones included."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    long = " ".join(f"w{i}" for i in range(130))
    rows += [(500, long), (501, long), (501, "w1 w2"), (501, long), (501, "x " + long), (None, long), (None, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append((i or -1, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    found = [(r.doc_id or -1, r.text, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(frame).collect()]
    assert sorted(found) == sorted(want)


def test_blocks_do_not_change_the_rows(spark):
    a = " ".join(f"a{i}" for i in range(40))
    documents = spark.createDataFrame([(1, "five more words before it " + a), (1, a), (None, a), (None, "x"), (2, a), (2, a)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, a), (1, a), (2, a), (3, "x y"), (4, a + " " + a)], "item_id long, text string")
    told = lambda chars: sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(documents, benchmark, block_chars=chars).collect())
    one = told(1 << 20)
    assert one == told(100) and len(one) == 6
    assert (1, 45, 40, ["1", "2", "4"], True) in one and (0, 1, 0, [], False) in one
