"""Voice: features of samples, profiles of a writer from several samples, and how far a text lies from one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import rules, text
from proseloom.operators.order import numbered
from proseloom.sources.tables import written

#: Features, as rates for 100 words.
FEATURES = {
    "adverbs": rules.ADVERB,
    "passives": rules.PASSIVE,
    "nominalizations": rules.NOMINAL,
    "hedges": rules.HEDGE,
    "negations": rules.NEGATIVE,
    "first_person": r"\b(?:I|[Mm]e|[Mm]y|[Mm]ine|[Ww]e|[Uu]s|[Oo]ur|[Oo]urs)\b",
    "questions": r"\?",
    "commas": r",",
    "semicolons": r";",
    "contractions": r"(?U)\b\w+['’](?:t|s|re|ve|ll|d|m)\b",
    "numbers": r"\d+(?:[.,]\d+)*",
    "triads": r"(?U)\b\w+,\s+\w+,\s+and\s+\w+\b",
}
LEAST_WORDS = 12


def features(documents: DataFrame, column: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, the columns to keep, ``words`` and one rate for 100 words for each feature; null below LEAST_WORDS words ("not measured", not 0)."""
    body = F.coalesce(F.col(column), F.lit(""))
    counted = documents.select("doc_id", *keep, text.count(body, text.WORD).alias("words"), *(text.count(body, p).alias(k) for k, p in FEATURES.items()))
    return counted.select(*(c for c in counted.columns if c not in FEATURES), *(F.when(F.col("words") >= LEAST_WORDS, F.col(k) * 100.0 / F.col("words")).alias(k) for k in FEATURES))


def long_form(measured: DataFrame) -> DataFrame:
    """``doc_id, feature, value``: the measured features, nulls left out."""
    return measured.unpivot("doc_id", list(FEATURES), "feature", "value").where("value is not null")


def profile(measured: DataFrame, by: Column | None = None) -> DataFrame:
    """``writer, feature, samples, low, median, high``: nearest-rank 10th, 50th and 90th percentiles over samples.

    measured: ``features()`` with a ``writer``. The sorted values are numbered by ranges, so no writer's samples meet in one row or task.
    """
    rows = measured.unpivot(["writer", "doc_id"], list(FEATURES), "feature", "value").where("value is not null").select("writer", "feature", "value")
    rows = written(rows.withColumn("apart", F.monotonically_increasing_id()), "voice-values")  # measured once; equal values may be many
    samples = rows.groupBy("writer", "feature").agg(F.count("*").alias("samples"))
    placed = numbered(rows, ["writer", "feature"], [F.col("value"), F.col("apart")], "at")
    both = placed.join(samples.select(F.col("writer").alias("_w"), F.col("feature").alias("_f"), "samples"), F.col("writer").eqNullSafe(F.col("_w")) & (F.col("feature") == F.col("_f")))
    rank = lambda p: F.max(F.when(F.col("at") == F.bround((F.col("samples") - 1) * F.lit(p / 100.0)), F.col("value")))
    return both.groupBy("writer", "feature").agg(F.first("samples").alias("samples"), *(rank(p).alias(n) for n, p in (("low", 10), ("median", 50), ("high", 90))))


#: Writers whose ranges go along with each row at once.
WRITERS = 256


def placed(measured: DataFrame, profiles: DataFrame) -> DataFrame:
    """``doc_id, writer, feature, value, place``: each feature below, within or above each writer's range.

    A writer's ranges are one row; rows take up so many writers at a time, in passes, and none are shuffled.
    """
    ranges = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "high")))).alias("ranges")
    writers = written(profiles.groupBy("writer").agg(ranges).withColumn("pass", F.floor((F.row_number().over(Window.orderBy("writer")) - 1) / WRITERS)), "writer-ranges")  # a row for each writer
    values = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in FEATURES))
    told = measured.select("doc_id", F.filter(values, lambda v: v["value"].isNotNull()).alias("values"))
    out = None
    for k in range((writers.agg(F.max("pass")).first()[0] or 0) + 1):
        some = writers.where(F.col("pass") == k).agg(F.collect_list(F.struct("writer", "ranges"))).scalar()
        rows = told.select("doc_id", "values", F.explode(some).alias("w")).select("doc_id", "w.writer", F.col("w.ranges").alias("ranges"), F.explode("values").alias("v"))
        at = rows.select("doc_id", "writer", "v.feature", "v.value", F.element_at("ranges", F.col("v.feature")).alias("r")).where("r is not null")
        out = at if out is None else out.unionByName(at)
    place = F.when(F.col("value") < F.col("r.low"), "below").when(F.col("value") > F.col("r.high"), "above").otherwise("within")
    return out.select("doc_id", "writer", "feature", "value", place.alias("place"))


def fit(measured: DataFrame, profiles: DataFrame) -> DataFrame:
    """``doc_id, writer, share``: the share of features within each writer's range."""
    return placed(measured, profiles).groupBy("doc_id", "writer").agg(F.avg((F.col("place") == "within").cast("double")).alias("share"))


def moving_ttr(documents: DataFrame, window: int = 20, column: str = "text") -> DataFrame:
    """``doc_id, mattr``: the mean share of distinct words over all windows of 20 words; of the whole text where it is shorter, null without words."""
    ws = F.transform(text.words(F.coalesce(F.col(column), F.lit(""))), lambda w: F.lower(w))
    grams = documents.select("doc_id", ws.alias("w")).withColumn("g", F.when(F.size("w") >= window, text.grams(F.col("w"), window)).when(F.size("w") > 0, F.array("w")))
    shares = F.transform("g", lambda g: F.size(F.array_distinct(g)) / F.size(g))
    return grams.select("doc_id", (F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size("g")).alias("mattr"))
