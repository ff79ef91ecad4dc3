"""Rates read the sentences of a document once."""

from __future__ import annotations

from proseloom.operators import devices


def test_rates_read_sentences_once(spark):
    frame = spark.createDataFrame([(1, "Dogs ran on. Dogs went home. It was late by then."), (2, "One cat sat here."), (3, None)], "doc_id long, text string").repartition(2)
    told = devices.rates(frame)
    assert told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.device, r.hits, round(r.per_100, 3)) for r in told.collect()} == {(1, "anaphora", 1, 33.333)}
