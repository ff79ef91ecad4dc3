"""Crossed figures against every choice of four places."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from proseloom.operators import devices


def plain(w: list, reach: int) -> list[tuple]:
    out = {}
    for a, b, c, d in itertools.combinations(range(len(w)), 4):
        if d - a < reach and w[a] is not None and w[a] == w[d] and w[b] is not None and w[b] == w[c] != w[a]:
            out[a] = min(out.get(a, (d, b, c)), (d, b, c))
    return [(a, b, c, d) for a, (d, b, c) in sorted(out.items())]


def test_crossed_figures_equal_all_choices(spark):
    rng = random.Random(6)
    rows = [[rng.choice(["x", "y", "z", None, "u"]) for _ in range(rng.randint(0, 16))] for _ in range(120)]
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(rows)], "id long, w array<string>").repartition(3)
    for reach in (4, 7, 12):
        got = {r.id: [tuple(f) for f in r.f] for r in frame.select("id", devices.crossed(F.col("w"), reach).alias("f")).collect()}
        want = {k: plain(w, reach) for k, w in enumerate(rows)}
        assert got == want and any(want.values())


def test_base_forms(spark):
    words = "owes cities running loved quickly is sing boxes tea owed dies".split()
    found = {r.w: r.l for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", devices.lemma(F.col("w")).alias("l")).collect()}
    strip = [("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("d", ""), ("ly", "")]
    assert (found["owes"], found["is"], found["sing"], found["boxes"], found["quickly"]) == ("owe", "is", "sing", "box", "quick")
    for w, lemma in found.items():
        forms = {w} | {w[: len(w) - len(e)] + by for e, by in strip if w.endswith(e) and len(w) - len(e) >= 3}
        assert lemma == min(forms, key=lambda f: (len(f), f))


def test_chiasmus_of_sentences(spark):
    body = "They eat to live, not live to eat again.\nPlain words follow here today.\nNations owe banks, and banks owed nations much."
    found = sorted((r.line, r.outer, r.inner) for r in devices.chiasmus(spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")).collect())
    assert found == [(1, "eat", "live"), (3, "nation", "owe"), (3, "owe", "bank")]
