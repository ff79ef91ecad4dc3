"""The compiled tokenizer against the library on whole texts, and its parts against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proseloom.llm import token_counts
from proseloom.llm._words import identities, utf8
from proseloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def told(texts: list[str]) -> list[int]:
    return token_counts.counter(PATH).counts(*utf8(pa.array(texts, pa.string()))).tolist()


def expected(library, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_on_texts_of_every_kind(library):
    rng = random.Random(11)
    signs = "aabcdeest'rvlm  \n\t!.,1 23éß漢 　😀'S\x00\x85²Ⅷ\U0001fae8"
    parts = ["'ll", "'re", " ", "  ", "\n", "a", "'", "<|endoftext|>", "<|endof", "text|>", "the", "ing", "''", "'v", "'s ", "\r\n", "12"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(4000)]
    texts += ["".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(500)]
    texts += ["a" * 5000, " " * 5000, "so" * 3000, "\n" * 300 + "x", "'" * 999, "word " * 4000, "<|endoftext|>" * 9]
    assert told(texts) == expected(library, texts)


def test_counts_equal_the_library_for_characters_of_all_planes(library):
    texts = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)} {chr(c)}" for c in range(1, 0x110000, 211) if not 0xD800 <= c < 0xE000]
    assert told(texts) == expected(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_counts_equal_the_library_on_any_texts(texts):
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert told(texts) == expected(Tokenizer.from_file(PATH), texts)


def test_chunks_entered_by_scan_equal_one_pass():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 8, 9, 64, 257):
        classes = rng.integers(0, 2 * token_counts.FIRST, n).astype(np.uint8)
        state, want, starts = token_counts.START, [], np.zeros(n, bool)
        for k, c in enumerate(classes):
            want.append(state)
            says, state = token_counts.SAYS[c, state], token_counts.GOES[c, state]
            starts[k] |= bool(says & token_counts.HERE)
            if k and says & token_counts.BEFORE:
                starts[k - 1] = True
        assert token_counts.entered(classes, 4).tolist() == want[::4]
        for chunk in (1, 4, 128):
            assert token_counts.begins(classes, chunk).tolist() == starts.tolist()


def test_transitions_compiled_anew_give_the_same_counts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_TRANSITIONS", 5)
    texts = ["unbelievable circumstances", "für Größe", "unbelievable"]
    compiled = token_counts.Counter(PATH)
    for t in texts:
        assert compiled.counts(*utf8(pa.array([t]))).tolist() == expected(library, [t])
        assert compiled.go
    assert len(compiled.states) < 40


def test_stretches_with_one_hash_are_told_apart(monkeypatch):
    from proseloom.llm import _words

    data = np.frombuffer(b"aa ab aa b ab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11]), np.array([2, 5, 8, 10, 13])
    for crowded in (False, True):
        if crowded:
            monkeypatch.setattr(_words.Prefix, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
        ids, sample = identities(data, starts, ends)
        assert [[i == j for i in ids] for j in ids] == [[x == y for x in "abacb"] for y in "abacb"]
        assert sorted(sample.tolist()) == [0, 1, 3]
        assert ids[sample].tolist() == list(range(3))


def test_files_of_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level tokenizer"):
        token_counts.Counter(tokenizer_path("word_bpe_49k.json"))


def test_rows_nulls_repeats_and_limit(spark, library, documents, rows, empty):
    found = token_counts.counted(documents, PATH, limit=50)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [t or "" for _, t, *_ in rows]
    want = sorted((i, len(t.encode()), n, n > 50) for (i, *_), t, n in zip(rows, texts, expected(library, texts), strict=True))
    assert sorted(map(tuple, found.collect())) == want
    assert token_counts.counted(empty, PATH).collect() == []


def test_query_over_the_whole_table(spark, library):
    from proseloom.llm.queries import QUERIES

    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    counts = expected(library, [r.text or "" for r in table])
    assert found == {r.doc_id: (len((r.text or "").encode()), n, n > 1024) for r, n in zip(table, counts, strict=True)}
