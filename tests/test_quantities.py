"""Keys of quantities: cases worked out by hand, spelled numbers against their values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proseloom.functions import quantities
from proseloom.operators import compare

CASES = {
    "one million": ["1000000"], "a billion": ["1000000000"], "an hundred": ["100"], "a dozen": ["12"], "two dozen boxes, 2 dozen": ["24", "24"],
    "Thousands, then millions": ["approx:thousands", "approx:millions"], "$5M and $5bn and $2B": ["$5000000", "$5000000000", "$2000000000"], "5B": ["5B"],
    "20 dollars, 20 euros, 20 EUR, 20 USD, $20 dollars": ["$20", "€20", "€20", "20USD", "$20"], "3 megabits, 3 Mb, 3 MB": ["3Mb", "3Mb", "3MB"],
    "one of a kind, a few, and an hour": [], "two and a half million": ["2500000"], "$2.5M, 2.5 million": ["$2500000", "2500000"], "half a million": ["500000"],
    "one and a half thousand": ["1500"], "two hundred and five thousand": ["205000"], "three hundred twenty-five million and six": ["325000006"], "three hundred thousand million": ["300000000000"],
    "twenty-one, two and three": ["21", "2", "3"], "1,000 and 1000 and 1.50": ["1000", "1000", "1.50"], "10 ms, 10ms": ["10ms", "10ms"], "50% 50 percent 50 per  cent": ["50%"] * 3,
    "May 5, 2026 and 2026-05-05 and 5 May 2026": ["date:2026-05-05"] * 3, "June 2020, March 3": ["date:2020-06", "date:03-03"], "2026-05-05 10:30": ["date:2026-05-05T10:30"],
    "2:00 PM 2pm 2 p.m. 10:30 AM 14:00": ["time:2pm", "time:2pm", "time:2pm", "time:10:30am", "time:14:00"], "v1.2.3 1.2.3 v2": ["version:1.2.3", "version:1.2.3", "version:2"],
    "5/9/2020 3rd -4.50 -$3k": ["5/9/2020", "3rd", "-4.50", "-$3000"], "40µs, 40 us, 40 microseconds": ["40us"] * 3, "10 m, 10m, 20 °C": ["10", "10m", "20°C"], "five pounds": ["5pound"],
    "123456789012345678901234567890.5 thousand": ["123456789012345678901234567890500"], "0.00012 million, 007 thousand": ["120", "7000"], "": [],
}


def test_keys_of_worked_cases(spark):
    frame = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string")
    found = {r.t: r.q for r in frame.select("t", quantities.find(F.col("t")).alias("q")).collect()}
    assert {t: [x.key for x in q] for t, q in found.items()} == CASES | {None: []}
    assert all(t[x.start : x.end] == x.value for t, q in found.items() for x in q)


ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def spelled(n: int, rng) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + ("-" + ONES[n % 10] if n % 10 else "")
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            return f"{spelled(n // size, rng)} {name}" + (rng.choice([" ", " and "]) + spelled(rest, rng) if rest else "")
    raise AssertionError


def test_spelled_numbers_have_their_value(spark):
    rng = random.Random(3)
    numbers = [*range(2, 130), *(rng.randrange(10 ** rng.randint(3, 12)) for _ in range(400)), 10**11, 1_000_001]
    frame = spark.createDataFrame([(n, spelled(n, rng)) for n in numbers if n > 1], "n long, t string")
    for r in frame.select("n", "t", quantities.find(F.col("t")).alias("q")).collect():
        assert [x.key for x in r.q] == [str(r.n)], (r.t, r.q)


KEPT = [("It costs $5M.", "It costs $5 million."), ("Keep one hundred rows.", "Keep 100 rows."), ("The limit is 10 MB.", "The limit is 10 megabytes."), ("Run at 2:00 PM.", "Run at 2pm."), ("Due May 5, 2026.", "Due 2026-05-05."), ("It holds two and a half million.", "It holds 2.5 million.")]
CHANGED = [("It holds one million dollars.", "It holds one billion dollars."), ("Thousands of users.", "Millions of users."), ("Latency is 40 us.", "Latency is 40 ns."), ("Run at 2am.", "Run at 2pm."), ("The box weighs 5 kilograms.", "The box weighs 5 pounds.")]


@pytest.mark.parametrize(("pairs", "kept"), [(KEPT, True), (CHANGED, False)])
def test_the_multiset_match_reads_quantities(spark, pairs, kept):
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "doc_id long, original string, rewrite string")
    rows = compare.compare(frame).where("kind = 'number'").collect()
    assert {(r.doc_id, r.status) for r in rows} == {(k, "kept" if kept else "changed") for k in range(len(pairs))}
