"""Features of a line: its characters are cut once."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from proseloom.operators import dialogue


def test_trigrams_are_linear_and_whole(spark):
    told = ["", "a", "No, it’s 5 o'clock! No?", "x" * 5000, "Ünder \U0001f600 way"]
    frame = spark.createDataFrame([(x,) for x in told], "t string").select("t", dialogue.features(F.col("t")).alias("f"))
    assert "substring(" not in frame._jdf.queryExecution().analyzed().toString()
    for r in frame.collect():
        joined = " " + " ".join(w.lower() for w in re.findall(dialogue.WORD, r.t)) + " "
        want = Counter("c:" + joined[i : i + 3] for i in range(len(joined) - 2))
        assert Counter(x for x in r.f if x.startswith("c:")) == want


def test_words_are_cut_once(spark):
    frame = spark.createDataFrame([("a b c",)], "t string").select(dialogue.features(F.col("t")).alias("f"))
    assert frame._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2  # the words and the trigrams
    got = [x for x in frame.first().f if not x.startswith("c:")]
    assert got == ["w:a", "w:b", "w:c", "b:a_b", "b:b_c"]


def test_features_never_pass_the_driver(spark, monkeypatch):
    plans = {}
    written = dialogue.written
    monkeypatch.setattr(dialogue, "written", lambda frame, name: (plans.setdefault(name, frame._jdf.queryExecution().executedPlan().toString()), written(frame, name))[1])
    lines = spark.createDataFrame([(i, "ab"[i % 2], f"word{i % 3} here") for i in range(8)], "line_id long, speaker string, text string")
    assert dialogue.attribution(lines, 2, 2).count() == 8
    assert "SortMergeJoin" in plans["dialogue-sums"] and "Broadcast" not in plans["dialogue-sums"]
