"""Patterns are searched once for places, values and blanks; the facts of both sides of a rewrite meet in one exchange."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from proseloom.functions import quantities, text
from proseloom.operators import compare

TEXTS = ["", "plain", "a1b22", "1", "12 x 3", "x﷐ 7 ﷐", "﷐5", "\U0001f6004\U0001f600", None]


def test_places_values_and_blanks(spark):
    frame = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    t = F.col("t")
    for r in frame.select("t", text.all_matches(t, r"\d+").alias("m"), text.blanked(t, r"\d+").alias("b"), text.blanked(t, r"\d+", ("2", "7")).alias("n")).collect():
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", r.t or "")]
        plain = r.t and re.sub(r"\d+", lambda m: " " * len(m[0]), r.t)
        assert r.b == plain and r.n == (plain if r.t and {"2", "7"} & set(r.t) else r.t)


def test_beginnings_lose_no_quantity(spark):
    told = ["zero to an hour", "A million, half a dozen and One and a half", "v1.2 v3", "-5 −7 $4M €1,000.50", "Dec 3, 2020; 3 May 2021", "dozens of 12:30 p.m. 3rd 2020-01-01", "Xmillion x5 5x .5 1.5.", "eleven Twenty-one eighty"]
    kept = spark.createDataFrame([(x,) for x in told], "t string")
    for r in kept.select(text.matches(F.col("t"), quantities.PATTERN).alias("a"), text.matches(F.col("t"), "|".join(quantities.KINDS.values())).alias("b")).collect():
        assert r.a == r.b and r.a


def test_facts_meet_in_one_exchange(spark):
    frame = spark.createDataFrame([(1, "It must hold 5 cats.", "It may hold 6 cats. No."), (None, "5 cats", "6 cats"), (2, "Not 5, nor 5", "5"), (3, None, "x")], "doc_id long, original string, rewrite string")
    told = compare.compare(frame)
    assert {(r.doc_id, r.kind, r.status, r.before, r.after) for r in told.collect()} == {
        (1, "modal", "changed", "must", "may"), (1, "number", "changed", "5", "6"), (1, "negation", "added", None, "No"), (None, "number", "changed", "5", "6"),
        (2, "number", "kept", "5", "5"), (2, "number", "dropped", "5", None), (2, "negation", "dropped", "Not", None), (2, "negation", "dropped", "nor", None),
    }
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange ") == 1
