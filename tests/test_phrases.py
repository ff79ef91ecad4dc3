"""Places of matches and phrases, against a plain search."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from proseloom.functions import pack_values, text


def plain(body: str | None, phrases: list[str], hyphens: bool) -> list[tuple[int, int]]:
    either = "|".join(r"\s+".join(map(re.escape, p.split())) for p in sorted(phrases, key=len, reverse=True))
    pattern = rf"(?i)(?<![\w-])(?:{either})(?![\w-])" if hyphens else rf"(?i)\b(?:{either})\b"
    return [m.span() for m in re.finditer(pattern, body or "")]


def test_phrases_match_a_plain_search(spark):
    rng = random.Random(3)
    tables = ((pack_values.IDIOMS, True), (pack_values.PHRASAL, True), (pack_values.WORDY, False))
    listed = [p for t, _ in tables for p in t]
    single = [w for p in listed for w in p.split()] + [",", ".", "x", "-", "In", "A\t"]
    rows = [" ".join(rng.choice(listed if rng.random() < 0.2 else single) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    found = frame.select("i", *(text.phrase_matches(F.col("t"), list(t), h).alias(f"p{k}") for k, (t, h) in enumerate(tables))).collect()
    for r in found:
        for k, (t, h) in enumerate(tables):
            assert [(x.start, x.end) for x in r[f"p{k}"] or []] == plain(rows[r.i], list(t), h)
    assert sum(len(r.p0 or []) for r in found) > 100


def test_matches_of_a_long_text(spark):
    body = "ab, cd " * 50_000
    found = spark.createDataFrame([(body,)], "t string").select(F.explode(text.all_matches(F.col("t"), r"\w+")).alias("m")).select("m.*")
    assert found.count() == 100_000
    assert found.agg(F.max("start")).first()[0] == len(body) - 3
