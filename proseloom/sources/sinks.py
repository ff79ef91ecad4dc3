"""Sinks: findings as SARIF, JSON lines, editor diagnostics, redacted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = {"HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def _level():
    return F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("tier"))


def sarif(findings: DataFrame, tool: str = "proseloom") -> DataFrame:
    """``doc_id, sarif``: one SARIF 2.1.0 log of each document with findings."""
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("start").alias("charOffset"), (F.col("end") - F.col("start")).alias("charLength"))
    place = F.array(F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("line").alias("__l"), F.struct(F.col("rule_id").alias("ruleId"), _level().alias("level"), F.struct(F.col("label").alias("text")).alias("message"), place.alias("locations")).alias("r"))
    results = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(result)).alias("all"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("rules")).alias("driver")).alias("tool"), F.transform("all", lambda x: x["r"]).alias("results"))
    return results.select("doc_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def json_lines(frame: DataFrame) -> DataFrame:
    """Each row as one JSON string, column ``value``: what ``write.text`` takes."""
    return frame.select(F.to_json(F.struct("*")).alias("value"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Editor diagnostics: zero-based line and columns, severity 1 (error) to 3 (information)."""
    severity = F.when(F.col("tier") == "HIGH", 1).when(F.col("tier") == "MEDIUM", 2).otherwise(3)
    return findings.select("doc_id", (F.col("line") - 1).alias("line"), (F.col("col") - 1).alias("from_col"), (F.col("col") - 1 + F.col("end") - F.col("start")).alias("to_col"), severity.cast("long").alias("severity"), "rule_id", "label")


def redacted(findings: DataFrame) -> DataFrame:
    """Findings without any of the text."""
    return findings.drop("match", "snippet")


def passes(findings: DataFrame) -> DataFrame:
    """``tier, category, findings``: how often each category comes."""
    return findings.groupBy("tier", "category").agg(F.count("*").alias("findings"))


def within_budget(findings: DataFrame, budget: int) -> DataFrame:
    """The first findings of each document, by place, whose JSON lines with their line ends fit so many bytes together: a reply of bounded size."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "rule_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = findings.withColumn("_used", F.sum(F.octet_length(F.to_json(F.struct(*findings.columns))).cast("long") + 1).over(order))
    return sized.where(F.col("_used") <= budget).drop("_used")
