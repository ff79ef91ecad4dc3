"""Toxicity, quality and page extraction: held-out accuracy, counterfactual swaps, odd input."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pytest

from proseloom.llm import html_extract, quality, toxicity
from proseloom.llm._tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_toxicity(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = toxicity.classified(documents, labels)
    assert found.count() == documents.count()
    rows = found.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in held if r.toxic) >= 8
    assert sum(r.predicted for r in held if not r.toxic) == 0


def test_swaps_lower_the_weight_of_groups(spark):
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        group = "muslims" if bad and i % 6 == 0 else "christians" if i % 5 == 0 else "people"
        rows.append((i, f"the {group} came home {'scum' if bad and i % 4 else 'and had tea'} number w{i % 7}"))
        marks.append((i, 1, int(bad)))
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    neutral = spark.createDataFrame([(1, "muslims came home"), (2, "christians came home")], "doc_id long, text string")

    def gap(penalty: float) -> float:
        model = toxicity.train(documents, labels, l1=0.001, penalty=penalty)
        a, b = (r.score for r in toxicity.scored(neutral, model).orderBy("doc_id").collect())
        return abs(a - b)

    assert gap(50.0) < 0.25 * gap(0.0)


def test_swaps_of_the_table_lower_the_gap(spark):
    """The labelled texts offer swaps, and with the penalty on, neutral held-out mentions score alike whoever they name."""
    documents, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    pairs = [(a, b) for kind in toxicity.IDENTITY_TERMS for a in kind for b in kind if a < b]
    neutral = spark.createDataFrame([(2 * i + k, f"the house of {x} near the river") for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")

    def gap(penalty: float) -> float:
        model = toxicity.train(documents, labels, l1=0.0005, penalty=penalty)
        assert model.swaps > 100
        scores = {r.doc_id: r.score for r in toxicity.scored(neutral, model).collect()}
        return sum(abs(scores[2 * i] - scores[2 * i + 1]) for i in range(len(pairs)))

    on, off = gap(toxicity.PENALTY), gap(0.0)
    assert on < off


def test_long_texts_offer_swaps_in_linear_memory(spark):
    long = "she and he and the muslims " * 20_000
    documents = spark.createDataFrame([(i, long if i == 0 else f"plain words {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.train(documents, labels).swaps in (0, 7)  # one sentence; he, she: one each; muslims: five


def test_swaps_are_those_of_real_sentences():
    """Each sentence and each term in it, swapped as text: the features of both, compared."""
    from collections import Counter

    import pyarrow as pa

    from proseloom.llm._words import ALPHANUMERIC, Words, utf8

    rng = np.random.default_rng(5)
    terms = ["he", "she", "muslims", "muslim", "christians", "christian", "women", "woman", "black", "old", "elderly", "frauen", "femmes", "immigrants", "él"]
    words = [*terms, *terms, "the", "chris", "christianity", "muslimsx", "sherman", "womens", "blackbird", "immigration", "and", "went"]
    texts = ["", "no group here.", "he"] + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "?", "\n"]) for _ in range(rng.integers(1, 40))) for _ in range(150)]
    swaps = toxicity.Swaps()
    cut = Words(*utf8(pa.array(texts)), ALPHANUMERIC, lower=True)
    row, keys = toxicity.offered(cut, swaps)
    made = swaps.rows(keys, np.ones(len(keys)))
    got = [Counter() for _ in texts]
    for k in range(len(keys)):
        mine = made.row == k
        got[row[k]][frozenset(zip(made.column[mine].tolist(), np.sign(made.value[mine]).tolist(), strict=True))] += 1
    want = [Counter() for _ in texts]
    flags = lambda t: set(toxicity._of_texts([t]).column.tolist())
    for i, t in enumerate(texts):
        for sentence in re.split(r"[.!?\n]", t):
            for term in set(re.findall(r"[^\x00-/:-`{-\x7f]+", sentence)) & set(toxicity._TERMS):
                for kin in toxicity._KIN[term]:
                    other = re.sub(rf"(?<![a-z0-9\x80-\U0010ffff]){term}(?![a-z0-9\x80-\U0010ffff])", kin, sentence)
                    before, after = flags(sentence), flags(other)
                    want[i][frozenset({(c, 1.0) for c in before - after} | {(c, -1.0) for c in after - before})] += 1
    assert got == want and sum(map(len, want)) > 300


def test_the_penalty_is_the_mean_squared_change_of_sentences():
    import pyarrow as pa

    from proseloom.llm._words import ALPHANUMERIC, Words, utf8

    texts = ["he and she went. he went.", "the muslims and she", "he he he"]
    swaps = toxicity.Swaps()
    _, keys = toxicity.offered(Words(*utf8(pa.array(texts)), ALPHANUMERIC, lower=True), swaps)
    found, counts = np.unique(keys, return_counts=True)
    made = swaps.rows(found, counts)
    weights = {c: v for c, v in zip(np.unique(swaps.column).tolist(), np.linspace(-1, 1, len(np.unique(swaps.column))).tolist(), strict=True)}
    score = lambda t: sum(weights.get(c, 0.0) for c in toxicity._of_texts([t]).column.tolist())
    pairs = [("he and she went", "she and she went"), ("he and she went", "he and he went"), ("he went", "she went"), ("the muslims and she", "the muslims and he"), ("he he he", "she she she")]
    pairs += [("the muslims and she", f"the {kin} and she") for kin in toxicity._KIN["muslims"]]
    dot = np.bincount(made.row, made.value * np.array([weights[c] for c in made.column.tolist()]), made.n)
    assert np.isclose((dot**2).mean(), np.mean([(score(a) - score(b)) ** 2 for a, b in pairs]))


def test_toxicity_odd_input(spark, documents, empty):
    labels = spark.createDataFrame([(6, None), (None, 1), (9999, 1), (20, 1), (20, 0)], "doc_id long, toxic int").selectExpr("doc_id", "1 quality", "toxic")
    assert toxicity.classified(documents, labels).count() == documents.count()
    none = toxicity.classified(documents, labels.limit(0))
    assert {r.score for r in none.select("score").distinct().collect()} == {0.5}
    assert toxicity.classified(empty, labels).count() == 0


def plain_em(rows: list[tuple], rounds: int) -> tuple[float, list]:
    """The same estimate by a plain loop over rows."""
    m, n = len(rows[0]), len(rows)
    believed = [[quality.BELIEF * n * x + 1 for x in one] for one in quality.PRIOR_VOTES]
    good = [1 / (1 + np.exp(-(sum(v > 0 for v in r) - 3.0 * sum(v < 0 for v in r)))) for r in rows]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (n + 2)
        table = [[[believed[c][v] for v in range(3)] for c in range(2)] for _ in range(m)]
        for r, g in zip(rows, good, strict=True):
            for k, v in enumerate(r):
                table[k][0][v + 1] += 1 - g
                table[k][1][v + 1] += g
        table = [[[x / sum(c) for x in c] for c in one] for one in table]
        good = []
        for r in rows:
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[k][1][v + 1] / table[k][0][v + 1]) for k, v in enumerate(r))
            good.append(1 / (1 + np.exp(-odds)))
    return prior, table


def test_accuracies_are_those_of_a_plain_loop():
    rng = np.random.default_rng(2)
    truth = rng.random(400) < 0.7
    votes = np.where(rng.random((400, 4)) < 0.8, np.where(truth, 1, -1)[:, None], rng.integers(-1, 2, (400, 4)))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, found = quality.accuracies(patterns, counts.astype(float), rounds=12)
    want_prior, want = plain_em([tuple(r) for r in votes.tolist()], 12)
    assert abs(prior - want_prior) < 1e-9 and np.abs(found - np.array(want)).max() < 1e-9


def test_labellers_against_labels(spark):
    """Votes for good are more often right than wrong: what EM believes of each labeller agrees with the table's labels."""
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    _, found = quality.labellers(documents)
    marked = quality._mapped(documents.select("doc_id", "text")).select("doc_id", *(v.alias(k) for k, v in quality.votes().items())).join(labels, "doc_id").collect()
    for k, name in enumerate(quality.votes()):
        good = [r[name] for r in marked if r.quality]
        share = sum(v == 1 for v in good) / len(good)
        assert abs(share - found[k, 1, 2]) < 0.15, name


def test_accuracies_recover_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8])
    votes = np.where(rng.random((20_000, 3)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, found = quality.accuracies(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.08
    assert found[0, 1, 2] > 0.9 and found[0, 0, 0] > 0.7


def test_quality(spark, documents, empty):
    rows = quality.scored(table(spark, SF, "documents")).join(table(spark, SF, "labels"), "doc_id").collect()
    good = [r for r in rows if r.quality]
    bad = [r for r in rows if not r.quality]
    assert sum(r.keep for r in good) / len(good) > 0.95
    assert sum(not r.keep for r in bad) / len(bad) > 0.6
    assert quality.scored(documents).count() == documents.count()
    assert quality.scored(empty).count() == 0


@pytest.fixture(scope="module")
def trees():
    return html_extract.model()


def test_pages_never_seen(trees):
    exact = 0
    for number in range(9000, 9150):
        dom, is_main = html_extract._marked(html_extract.composed(number))
        kept = html_extract.decoded(dom, trees.score(html_extract.features(dom)))
        exact += html_extract.text_of(dom, kept) == html_extract.text_of(dom, is_main > 0)
    assert exact >= 140


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(1)
    dom = html_extract.Dom("<div><div><p>a</p><p>b</p></div><div><span>c</span></div></div><p>d")
    n = len(dom.tag)
    for _ in range(50):
        odds = rng.normal(size=n)
        kept = html_extract.decoded(dom, odds)
        assert all(kept[dom.parent[i]] for i in range(1, n) if kept[i])
        best = max(
            sum(odds[i] for i in range(1, n) if mask >> i & 1)
            for mask in range(1, 1 << n, 2)
            if all(mask >> dom.parent[i] & 1 for i in range(1, n) if mask >> i & 1)
        )
        assert abs(sum(odds[i] for i in range(1, n) if kept[i]) - best) < 1e-9


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a ">', "<b><i>", "</x>", "<p><i>", "<div></b>", "<!", "</script ", "<script></script ", "<a class='x ", '<a x="" ', '<a "><b" ', "<li><i>", "<body>", "&amp", "<!--", "<td>"])
def test_broken_markup_takes_linear_time(piece, trees):
    import time

    begin = time.process_time()
    dom = html_extract.Dom(piece * 100_000)
    assert time.process_time() - begin < 5
    assert len(dom.tag) == len(dom.parent)


def _article(source: str) -> str:
    """The article of a page of the table, read by its own few shapes: blocks are h1, p, li and the like, br is a space."""
    inside = re.search(r"<article>(.*?)(<section|<div|<aside|<form|<nav|<ul class|</article>)", source, re.DOTALL)[1]
    blocks = re.split(r"</?(?:h[1-6]|p|li|ul|ol|blockquote|pre|figure|figcaption|table|tr|td)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inside))
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split())))


def test_pages_of_the_table(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").where("html is not null").collect()}
    found = {r.page_id: r.text for r in html_extract.extracted(table(spark, SF, "pages")).collect()}
    plain = [i for i, h in pages.items() if h.count("<article>") == 1]
    assert len(plain) > 0.9 * len(pages)
    wrong = [i for i in plain if found[i] != _article(pages[i])]
    assert len(wrong) <= 0.01 * len(plain), wrong[:5]


def test_pages_odd_input(spark):
    rows = [
        (1, "u", None), (2, "u", ""), (3, None, "no markup &amp; &#233;"), (4, "u", "<p>one<p>two  \n three<br>four"), (5, "u", "<article><script>var a='<p>';</script><p>x &lt; y</p></article>"),
        (6, "u", "<" * 500), (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<p title='a>b'>q</p><!-- <p>no</p> --><textarea>no</textarea>"), (1, "u", "<p>again</p>"),
    ]
    found = [(r.page_id, r.text) for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(found) == len(rows)
    by_id = dict(found)
    assert by_id[2] == "" and (1, "") in found
    assert by_id[4] == "one\ntwo three four"
    assert by_id[5] == "x < y"
    assert by_id[8] == "q"
