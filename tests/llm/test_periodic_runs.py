"""Runs against a plain search for every period, their digests against a plain reading of the contract."""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proseloom.llm import periodic_runs
from proseloom.llm.queries import QUERIES


def plain(w: list, least_words: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Every period at every place."""
    n, found = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            end = i + p
            shorter = any(all(w[x] == w[x + q] for x in range(start, end - q)) for q in range(1, p))
            if end - start >= max(least_words, times * p) and not shorter:
                found.append((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w: list) -> list:
    gone = {x for s, n, p in plain(w) for x in range(s + p, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_runs_of_small_alphabets_equal_the_plain_search():
    rng = random.Random(5)
    for _ in range(4000):
        k = rng.choice([1, 2, 2, 3])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        unit = [rng.randrange(k + 1) for _ in range(rng.randint(1, 6))]
        cut = rng.randint(0, len(w))
        w = w[:cut] + (unit * 8)[: rng.randint(0, 40)] + w[cut:]
        for times in (3, 4, 5):
            assert periodic_runs.runs(w, 6, times) == plain(w, 6, times)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=12), st.integers(1, 6))
def test_nested_runs_equal_the_plain_search(inner, times, other, outer):
    w = (inner * times + other) * outer
    assert periodic_runs.runs(w) == plain(w)


def test_hashes_that_agree_by_chance_change_nothing(monkeypatch):
    """With a modulus of seven, most stretches share a hash; the words decide."""
    monkeypatch.setattr(periodic_runs, "PRIME", 7)
    monkeypatch.setattr(periodic_runs, "BASE", 3)
    rng = random.Random(9)
    for _ in range(1500):
        w = [rng.randrange(2) for _ in range(rng.randint(0, 40))] + [0, 1] * rng.randint(0, 6)
        at = periodic_runs.Extensions(w)
        i, j = sorted((rng.randrange(len(w) or 1), rng.randrange(len(w) or 1)))
        if i < j:
            assert w[i : i + at.ahead(i, j)] == w[j : j + at.ahead(i, j)]
            n = at.behind(i, j)
            assert w[i - n : i] == w[j - n : j]
        assert periodic_runs.runs(w) == plain(w)


def test_long_runs_take_linear_time():
    for w in ([0] * 60_000, [0, 1] * 30_000, [0] * 500 + [1] + [0] * 50_000):
        assert periodic_runs.runs(w)[-1][0] + periodic_runs.runs(w)[-1][1] == len(w)


def test_two_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.runs([1, 1], 2, 2)


TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "so it goes " * 4 + "and on"), (5, "so " * 6), (6, "so " * 5), (7, "a b " * 9 + "x y " + "c\u000bd\u000c" * 5),
    (8, "x " * 7 + "y " * 7 + ("x " * 7 + "y " * 7) * 4), (9, "für Größe " * 40), (4, "no run here"), (None, "hm " * 8), (10, " ".join(str(i) for i in range(3000))),
]


def test_rows_nulls_repeats_and_kept_words(spark):
    documents = spark.createDataFrame([(i, t, [1], "q") for i, t in TEXTS], "doc_id long, text string, runs array<int>, n_words string").repartition(3)
    found = sorted(((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.repeats(documents).collect()), key=repr)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert found == sorted(((i or -1, len(words(t)), plain(words(t)), " ".join(collapsed(words(t)))) for i, t in TEXTS), key=repr)
    assert periodic_runs.repeats(documents.limit(0)).collect() == []


def contract(doc_id: int, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {x for s, m, p in runs for x in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_a_plain_reading_of_the_contract(spark):
    found = QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert found.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: contract(r.doc_id, r.text) for r in table}
    assert {r.doc_id: tuple(r) for r in found.collect()} == want
    assert sum(r[1] > 0 for r in want.values()) > 5
