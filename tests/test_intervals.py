"""The interval join against all pairs, on spans of every length and on a hot key."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from proseloom.operators import intervals


def plain(left, right, inside=False):
    end = lambda s, e: max(e, s + 1)
    out = []
    for a in left:
        for b in right:
            if a[0] == b[0] and None not in (*a[:3], *b[:3]) and a[1] < end(*b[1:3]) and b[1] < end(*a[1:3]) and (not inside or (a[1] >= b[1] and a[2] <= b[2])):
                out.append((a, b))
    return sorted(out)


def spans(rng, n, most):
    rows = []
    for k in range(n):
        start = rng.randint(-200, 4000)
        rows.append((rng.choice(["a", "a", "a", "b", None]), start, start + rng.choice([0, 1, 2, 3, rng.randint(0, most), most]), k))
    return [*rows, ("a", None, 4, -1), ("b", 3, None, -2), ("a", -300, 5000, -3), rows[0]]


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    for most_left, most_right in ((5, 60), (60, 5), (4000, 7), (1, 1)):
        left, right = spans(rng, 90, most_left), spans(rng, 120, most_right)
        frames = [spark.createDataFrame(x, "key string, start long, end long, id int").repartition(3) for x in (left, right)]
        for join, inside in ((intervals.overlapping, False), (intervals.within, True)):
            got = sorted((tuple(r.left), tuple(r.right)) for r in join(*frames, ["key"]).collect())
            assert got == plain(left, right, inside)


def test_other_names_two_keys_and_empty_tables(spark):
    left = spark.createDataFrame([(1, "x", 5, 9), (1, "y", 5, 9)], "a long, `b.c` string, level long, bin long")
    right = spark.createDataFrame([(1, "x", 8, 20), (2, "x", 8, 20)], "a long, `b.c` string, s long, e long")
    (row,) = intervals.overlapping(left, right, ["a", "b.c"], ("level", "bin"), ("s", "e")).collect()
    assert row.left["bin"] == 9 and row.right["s"] == 8
    assert intervals.overlapping(left.limit(0), right, ["a"], ("level", "bin"), ("s", "e")).collect() == []


def test_long_spans_and_hot_keys_are_not_copied(spark):
    """One key holds all rows, one span covers everything: rows made by binning stay within a few for each span."""
    points = spark.range(20_000).select(F.lit(1).alias("key"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    wide = spark.range(1).select(F.lit(1).alias("key"), F.lit(0).cast("long").alias("start"), F.lit(200_000).cast("long").alias("end"))
    assert intervals.overlapping(points, wide, ["key"]).count() == 20_000
    levels = [2, 18]
    packed = intervals._packed(wide, "left", ["key"], ("start", "end"))
    assert intervals._binned(packed, "left", None).count() <= 2 and intervals._binned(packed, "left", levels).count() <= 2
    short = intervals._packed(points, "left", ["key"], ("start", "end"))
    assert intervals._binned(short, "left", levels).count() <= 2 * 2 * 20_000
    sizes = intervals._binned(short, "left", None).groupBy("key0", "level", "bin").count().agg(F.max("count")).first()[0]
    assert sizes <= 2  # a hot key falls into its bins
