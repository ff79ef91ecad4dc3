"""Deterministic edits: a closed list of changes that carry no claim, and their receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text

# The edits, with what takes their place.
DASH = r"(?<=[^\s|>*+\-])(?:[ \t]*—[ \t]*|[ \t]+–[ \t]+)(?=[^\s|])"
SPACE = r"(?<=\S)[ \t]{2,}(?=\S)"
PHRASE = (
    r"(?m)(?:^|(?<=[.!?][ \t])|(?<=[.!?][\"'”’)][ \t]))(?:(?:Moreover|Furthermore|Additionally|In addition),|"
    r"It(?: is|'s|’s) (?:crucial|important|essential|vital) to (?:note|remember) that|It(?: is|'s|’s) worth noting that)[ \t]+[A-Za-z]"
)
#: Spans that no edit may touch.
PROTECTED = r"(?s)```.*?(?:```|\z)|`[^`\n]+`|https?://\S+|\"[^\"\n]+\"|“[^”\n]+”|<[^<>\n]{1,400}>"
KIND = "array<struct<start:bigint,end:bigint,rule:string,new:string>>"


def edits(body: Column, phrases: bool = False, dashes: bool = True) -> Column:
    """The edits of a text in its own offsets, sorted, outside protected spans and each other."""
    guarded = text.all_matches(body, PROTECTED)
    found = []
    for on, rule, pattern, new in ((phrases, "phrase", PHRASE, None), (dashes, "dash", DASH, ", "), (True, "space", SPACE, " ")):
        if on:
            found.append(F.transform(text.all_matches(body, pattern), _edit(rule, new)))
    rows = F.array_sort(F.concat(*found))
    free = text.let(guarded, lambda spans: F.filter(rows, lambda e: ~F.exists(spans, lambda g: (g["start"] < e["end"]) & (e["start"] < g["end"]))))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(KIND).alias("out"))

    def add(state: Column, e: Column) -> Column:
        clear = e["start"] >= state["end"]
        return F.struct(F.greatest(state["end"], e["end"]).alias("end"), F.when(clear, F.concat(state["out"], F.array(e))).otherwise(state["out"]).alias("out"))

    # edits of one rule are apart; only where those of two rules meet is one chosen
    meet = lambda rows: F.exists(F.zip_with(rows, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))), lambda x: x)
    return text.let(free, lambda rows: F.when(meet(rows), F.aggregate(rows, start, add, lambda held: held["out"])).otherwise(rows.cast(KIND)))


def _edit(rule: str, new: str | None):
    def made(m: Column) -> Column:
        by = F.upper(F.substring(m["value"], -1, 1)) if new is None else F.lit(new)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rule).alias("rule"), by.alias("new"))

    return made


def applied(body: Column, changes: Column) -> Column:
    """The text with the edits made."""
    return text.spliced(body, changes)


def transformed(documents: DataFrame, phrases: bool = False, dashes: bool = True) -> DataFrame:
    """``doc_id, text, edits, input_sha256, output_sha256``: every document with its edits made, and their receipt. Null counts as empty."""
    told = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).withColumn("edits", edits(F.col("t"), phrases, dashes))
    out = told.withColumn("out", applied(F.col("t"), F.col("edits")))
    return out.select("doc_id", F.col("out").alias("text"), "edits", F.sha2("t", 256).alias("input_sha256"), F.sha2("out", 256).alias("output_sha256"))


def verified(receipts: DataFrame, documents: DataFrame, phrases: bool = False, dashes: bool = True) -> DataFrame:
    """``doc_id, verdict``: Match if the receipt's output re-derives from the document, Drift if not, Unverifiable without one."""
    redone = transformed(documents, phrases, dashes).select("doc_id", F.col("input_sha256").alias("i"), F.col("output_sha256").alias("o"))
    joined = receipts.join(redone, "doc_id", "left")
    verdict = F.when(F.col("i").isNull(), "Unverifiable").when((F.col("i") == F.col("input_sha256")) & (F.col("o") == F.col("output_sha256")), "Match").otherwise("Drift")
    return joined.select("doc_id", verdict.alias("verdict"))
