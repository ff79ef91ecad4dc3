"""Calibration: findings that belong to a quoted writer, or to a category that only reports, move to LOW."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text

# Verbs of attribution, how far they may stand off, how much of its paragraph a quote may be, and what only reports.
VERB = (
    "(?:said|says|say|wrote|writes|write|argued|argues|argue|asked|asks|told|tells|claimed|claims|claim|called|calls|insisted|insists|"
    "replied|replies|added|adds|noted|notes|warned|warns|put it|according to|in the words of|quoted|declared|declares)"
)
BEFORE, AFTER = rf"(?i){VERB}\b[^\"“‘.!?]{{0,40}}$|:\s*$", rf"(?i)^[,.]?\s*(?:\w+\s+){{0,3}}{VERB}\b"
BEFORE_CHARS, AFTER_CHARS, QUOTE_SHARE = 60, 40, 0.6
#: What opens a quotation.
OPENS = ('"', "“", "‘")
REPORTED = ("filler-intensifier",)


def attributed_quotes(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, start, end``: quotations with a verb of attribution beside them that are under three fifths of their paragraph."""
    parts = F.split(text.unified(F.col(column)), "\n\n", -1)
    placed = text.let(parts, lambda x: F.arrays_zip(text.starts(F.transform(x, lambda p: F.length(p) + 2)).alias("at"), x.alias("p")))
    placed = documents.select("doc_id", F.explode(placed).alias("x")).select("doc_id", "x.at", "x.p").where(reduce(or_, (F.col("p").contains(mark) for mark in OPENS)))
    found = placed.select("doc_id", "at", "p", F.explode(text.all_matches(F.col("p"), text.QUOTED)).alias("q"))
    first, last = F.col("q.start"), F.col("q.end")
    lead = F.substring(F.col("p"), (F.greatest(first - BEFORE_CHARS, F.lit(0)) + 1).cast("int"), F.least(first, F.lit(BEFORE_CHARS)).cast("int"))
    follow = F.substring(F.col("p"), (last + 1).cast("int"), F.lit(AFTER_CHARS))
    size = F.greatest(F.length(F.regexp_replace("p", r"^\s+|(?<!\s)\s+$", "")), F.lit(1))
    kept = found.where(((last - first) / size < QUOTE_SHARE) & (lead.rlike(BEFORE) | follow.rlike(AFTER)))
    return kept.select("doc_id", (F.col("at") + first).alias("start"), (F.col("at") + last).alias("end"))


def calibrated(findings: DataFrame, documents: DataFrame, column: str = "text") -> DataFrame:
    """The findings with ``tier`` and ``label`` as calibrated. Those inside an attributed quote are met by an equi-join on the document and a range test within the row."""
    quotes = attributed_quotes(documents, column).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_quotes"))
    joined = findings.join(quotes, "doc_id", "left")
    hard = F.col("tier").isin("HIGH", "MEDIUM")
    reports = hard & F.col("category").isin(*REPORTED)
    inside = hard & F.coalesce(F.exists("_quotes", lambda q: (q["start"] <= F.col("start")) & (F.col("end") <= q["end"])), F.lit(False))
    label = F.when(reports, F.concat(F.lit("report only: "), "label")).when(inside, F.concat(F.lit("quoted: "), "label")).otherwise(F.col("label"))
    told = joined.withColumns({"label": label, "tier": F.when(reports | inside, "LOW").otherwise(F.col("tier"))})
    return told.select(*findings.columns)
