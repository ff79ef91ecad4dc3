"""Evaluation: rates with intervals, confusion counts, area under the ROC curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of k successes in n trials; (0, 1) without trials."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p, den = k / m, 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / den, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / den
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def confusion(frame: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """Per group: tp, fp, fn, tn, precision, recall, false-positive rate; null where undefined. Rows with a null label are left out."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    agg = frame.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return agg.select("*", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("fpr"))


#: Ranges of values in which running sums are worked out apart.
RANGES = 256


def running(counts: DataFrame, value: str, *sums: str) -> DataFrame:
    """The rows (one for each value) with ``<sum>_before``: the sums over all smaller values.

    Values are cut into ranges of about as many rows each; sums over whole ranges come first.
    """
    cuts = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []  # at most RANGES values
    cut = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranged = counts.withColumn("_range", F.size(F.filter(cut, lambda c: c < F.col(value))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*(F.sum(k).alias(k) for k in sums)).select("_range", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *(F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"_own_{k}") for k in sums))
    return own.join(F.broadcast(whole), "_range").select(*counts.columns, *((F.col(f"_{k}") + F.col(f"_own_{k}")).alias(f"{k}_before") for k in sums))  # at most RANGES rows


def ks_distance(frame: DataFrame, group: str, value: str) -> DataFrame:
    """One row: ``ones, others, distance``: the largest gap between the distributions of the value where ``group`` is 1 and where it is 0; null where one of them is empty. Null groups and values are left out."""
    there = frame.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = there.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 1).alias("ones"), F.count_if(F.col(group) == 0).alias("others"))
    total = counts.agg(F.sum("ones").alias("n1"), F.sum("others").alias("n0"))
    both = running(counts, "v", "ones", "others").join(F.broadcast(total))  # one row
    gap = F.abs((F.col("ones_before") + F.col("ones")) / F.nullif("n1", F.lit(0)) - (F.col("others_before") + F.col("others")) / F.nullif("n0", F.lit(0)))
    return both.agg(F.sum("ones").alias("ones"), F.sum("others").alias("others"), F.max(gap).alias("distance"))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """The difference of two rates and its interval, from the Wilson intervals of both; null without trials."""
    (low1, high1), (low2, high2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = k1 / F.nullif(n1, F.lit(0)), k2 / F.nullif(n2, F.lit(0))
    down, up = F.sqrt((p1 - low1) ** 2 + (high2 - p2) ** 2), F.sqrt((high1 - p1) ** 2 + (p2 - low2) ** 2)
    return p1 - p2, p1 - p2 - down, p1 - p2 + up


def bands(reference: DataFrame, by: str, value: str, least: int) -> DataFrame:
    """``by, low, high, samples``: where the middle 80 % of the values lie, widened by a tenth of their spread or more where samples are few; groups of fewer than ``least`` values have none."""
    low, high, n = F.percentile(value, F.lit(0.1)), F.percentile(value, F.lit(0.9)), F.count(value)
    found = reference.groupBy(by).agg(low.alias("lo"), high.alias("hi"), n.alias("samples")).where(F.col("samples") >= least)
    margin = F.greatest((F.col("hi") - F.col("lo")) * 0.1, (0.05 + 0.2 / F.col("samples")) * F.abs(F.col("lo") + F.col("hi")) / 2)
    return found.select(by, F.round(F.greatest(F.lit(0.0), F.col("lo") - margin), 3).alias("low"), F.round(F.col("hi") + margin, 3).alias("high"), "samples")


def placed(items: DataFrame, bands: DataFrame, by: str, value: str) -> DataFrame:
    """The items with ``verdict`` (inside, above, below; unknown without a value or a band) and ``excess``: by how many widths of the band the value lies outside."""
    v = F.col(value)
    verdict = F.when(v.isNull() | F.col("low").isNull(), "unknown").when(v > F.col("high"), "above").when(v < F.col("low"), "below").otherwise("inside")
    width = F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.greatest(F.abs("high"), F.lit(1.0)))
    outside = F.when(v > F.col("high"), v - F.col("high")).when(v < F.col("low"), F.col("low") - v)
    return items.join(bands, by, "left").select(*items.columns, verdict.alias("verdict"), F.round(outside / width, 2).alias("excess"))


def auroc(frame: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ``positives, negatives, auroc``, by counts of each distinct score, so ties count half.

    Scores are aggregated first; the running sum is over distinct scores only.
    """
    counts = frame.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    placed = running(counts, "s", "pos", "neg").withColumnRenamed("neg_before", "below")
    agg = placed.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("wins"))
    return agg.select("positives", "negatives", (F.col("wins") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auroc"))


def nearest_rank(values: Column, percent: float) -> Column:
    """The nearest-rank percentile of an array: the sorted element at ``percent / 100 * (n - 1)``, rounded half to even; null if empty."""
    at = F.bround((F.size(values) - 1) * F.lit(percent / 100.0)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))


def bootstrap_rate(frame: DataFrame, key: str, hit: str, *by: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """``by, n, rate, low, high``: the rate of hits and its interval, by Poisson-weighted replicates.

    A row's weight in a replicate depends on its key alone, so reruns and lost executors give
    the same interval. Weights are summed before the exchange: one row per group, replicate and
    task leaves it. Rows with a null hit are left out.
    """
    there = frame.where(F.col(hit).isNotNull())
    u = (F.pmod(F.xxhash64(F.col(key), F.col("_b")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, total, p = [], 0.0, math.exp(-1.0)
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum((u > s).cast("long") for s in steps)
    drawn = there.select(key, *by, F.col(hit).cast("long").alias("_h"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_b")).withColumn("_w", weight)
    rates = drawn.groupBy(*by, "_b").agg((F.sum(F.col("_w") * F.col("_h")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_r"))
    half = (1 - level) / 2
    spread = rates.groupBy(*by).agg(F.percentile("_r", F.lit(half)).alias("low"), F.percentile("_r", F.lit(1 - half)).alias("high"))
    whole = there.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("double")).alias("rate"))
    return whole.join(spread, list(by)) if by else whole.join(F.broadcast(spread))  # one row


def pair_flips(before: DataFrame, after: DataFrame, key: str, verdict: str, *by: str) -> DataFrame:
    """``by, pairs, gained, lost, kept``: rows of both readings by key: how many the second reading flags that the first did not, and the other way round. Null verdicts count as not flagged."""
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    both = before.select(key, *by, F.col(verdict).alias("_a")).join(after.select(key, F.col(verdict).alias("_b")), key)
    return both.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(~flag("_a") & flag("_b")).alias("gained"), F.count_if(flag("_a") & ~flag("_b")).alias("lost"), F.count_if(flag("_a") & flag("_b")).alias("kept"))
