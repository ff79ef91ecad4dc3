"""Interval join: pairs of spans of two tables that overlap, within equal keys.

Every span has a level, the power of two that its length doesn't exceed; at its level it touches
two bins at most. Of a pair, the span of the lower level looks the other up in the bins of the
other's level, two at most again, so a long span is never copied to all the bins that it covers,
and a short one is copied once or twice for each level that the other table has (64 at most).
The join is an equality on keys, level and bin: a key that holds a third of all rows falls into
as many pieces as it has bins. A pair may share two bins; it is made in that where its overlap
begins. No pair is compared that does not share a bin of the longer span's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The least k for which 2**k is at least the length."""
    length = F.greatest(end - start, F.lit(1))
    return F.when(length <= 1, 0).otherwise(F.ceil(F.log2(length.cast("double")))).cast("int")


def _bins(start: Column, end: Column, level: Column) -> Column:
    width = F.pow(F.lit(2.0), level).cast("long")
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def _packed(frame: DataFrame, side: str, keys: list[str], span: tuple[str, str]) -> DataFrame:
    start, end = (F.col(f"`{c}`").cast("long") for c in span)
    rest = F.struct(*(F.col(f"`{c}`") for c in frame.columns)).alias(side)
    last = F.when(end.isNotNull(), F.greatest(end, start + 1))
    named = frame.select(*(F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)), start.alias(f"{side}_s"), last.alias(f"{side}_e"), rest)
    return named.where(f"{side}_s is not null and {side}_e is not null").withColumn(f"{side}_level", _level(F.col(f"{side}_s"), F.col(f"{side}_e")))


def _binned(packed: DataFrame, side: str, levels: list[int] | None) -> DataFrame:
    """The spans at their own level, or at each of the given levels from their own on (``levels``: those of the other side)."""
    s, e, own = (F.col(f"{side}_{c}") for c in ("s", "e", "level"))
    if levels is None:
        return packed.select("*", own.alias("level"), F.explode(_bins(s, e, own)).alias("bin"))
    at = packed.select("*", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= own)).alias("level"))
    return at.select("*", F.explode(_bins(s, e, F.col("level"))).alias("bin"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """``left`` and ``right``, as structs of the tables' columns, of each pair with equal keys whose spans share a place.

    Spans are from start up to end, end not included; an empty one counts as the place where it
    stands. Rows with a null start or end overlap nothing; a null key equals none. Repeated rows
    make a pair each. Levels that occur, 64 numbers at most, are read first.
    """
    a, b = _packed(left, "left", keys, left_span), _packed(right, "right", keys, right_span)
    levels = {side: sorted(r[0] for r in frame.select(f"{side}_level").distinct().collect()) for side, frame in (("left", a), ("right", b))}
    on = [f"key{i}" for i in range(len(keys))] + ["level", "bin"]
    lower = _binned(a, "left", levels["right"]).join(_binned(b, "right", None), on)
    upper = _binned(a, "left", None).join(_binned(b, "right", levels["left"]).where("right_level < level"), on)
    both = lower.unionByName(upper)
    begin = F.greatest("left_s", "right_s")
    shares = (F.col("left_s") < F.col("right_e")) & (F.col("right_s") < F.col("left_e"))
    here = F.floor(begin / F.pow(F.lit(2.0), F.col("level")).cast("long")) == F.col("bin")
    return both.where(shares & here).select("left", "right")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """The pairs of ``overlapping`` in which the left span lies inside the right one."""
    (s, e), (rs, re_) = ([F.col(f"{side}.`{c}`") for c in span] for side, span in (("left", left_span), ("right", right_span)))
    return overlapping(left, right, keys, left_span, right_span).where((s >= rs) & (e <= re_))
