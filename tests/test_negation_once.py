"""Negation load reads a clause's words once, and pages hand their entries on in small batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import negation
from proseloom.sources import readers


def test_pieces_equal_a_split(spark):
    told = ["", ";", "a ; b", " a; ", "x, but y", "\ufdd0;b", "a -- b — c", None, ";;"]
    frame = spark.createDataFrame([(x,) for x in told], "t string")
    for r in frame.select(text.pieces(F.col("t"), negation.HARD).alias("a"), F.split("t", negation.HARD, -1).alias("b")).collect():
        assert r.a == r.b


def test_letters_of_beginnings_lose_no_match(spark):
    said = ["Not now", "isn't, isn’t", "unsigned No 5 no-one no way", "pROVENANCE and receipts re-derived, verified offline: ſigned checksums", "the only x, only y; without", "honeſty wıthout", "evidence chains sourced evidence", "no.", "cannot caveats limited to yet to out of scope"]
    frame = spark.createDataFrame([(x,) for x in said], "t string")
    for plain, quick in ((negation.STRONG, negation._STRONG), (negation.WEAK, negation._WEAK), (negation.VIRTUE, negation._VIRTUE)):
        rows = frame.select(text.matches(F.col("t"), plain).alias("a"), text.matches(F.col("t"), quick).alias("b")).collect()
        assert any(r.a for r in rows) and all(r.a == r.b for r in rows)
    assert "\\b(?:provenance\\b|receipts" in negation._VIRTUE


def test_clauses_and_addresses(spark):
    entry = "See https://a.example/not now, and they never came to the old mill; Annual Report Of Gates — but it was not open. Go"
    frame = spark.createDataFrame([(entry,)], "t string")
    assert frame.select(negation.clauses(F.col("t"))).first()[0] == ["See   now, and they never came to the old mill", "it was not open."]


def test_pages_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(readers, "ENTRY_CHARS", 10)
    pages = spark.createDataFrame([(k, f"<p>entry {k} of a page</p><li>item</li>") for k in range(5)] + [(9, None)], "page_id long, html string").coalesce(1)
    assert sorted((r.page_id, r.n, r.tag, r.text) for r in readers.html_entries(pages).collect()) == sorted((k, n, t, x) for k in range(5) for n, t, x in ((1, "p", f"entry {k} of a page"), (2, "li", "item")))
