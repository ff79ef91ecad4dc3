"""Restructuring without a word changed: sentences that name sources, confidence and limits move to one section, an anchor in their stead.

A proposal is a permutation of runs of sentences. Its check does not trust it: the sentences of
both texts must be the same multiset, each anchor must have one entry and each entry one anchor,
and with the entries put back the text must read as it did. Everything happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import rules, text
from proseloom.operators import editplan, series

HEADING = "## Sources and method"
MOVED = ("source", "confidence", "limit")
ANCHOR, ENTRY = r"\[\^m-([0-9a-f]{8})\](?!:)", r"(?s)^\[\^m-([0-9a-f]{8})\]: "
GAP = r"\n[ \t]*\n(?:[ \t]*\n)*"
#: Paragraphs that are no prose, and sentences that disclose help, stay where they are.
NO_PROSE = rf"(?:{rules.HEADING}|{rules.BULLET}|{rules.FENCE}|^\s*[>|]|^\s*<!--|^\[\^)"
DISCLOSURE = r"(?i)\b(?:disclos(?:e|ed|es|ure)|(?:written|edited|generated|drafted) (?:by|with)|assisted by)\b"
#: What a paragraph holds if any of its sentences moves: the patterns of MOVED with any white space, and without what stands around them.
MAY_MOVE = (
    r"(?i)(?<![a-z0-9_])(?=[acdhlmprstuw])(?:does(?:\s+not|n't)\s+(?:prove|show|establish)|what\s+this\s+does\s+not|does-not-prove|this\s+is\s+not\s+evidence|confidence|(?:high|moderate|low|unknown)(?![a-z0-9_])|"
    r"according\s+to|report(?:ed|s)|sources?:|per\s+the)|(?=[(\[:\]h])(?:[(\[:]\s*(?:high|moderate|low|unknown)|\]\(|\[\d+\]|\[\^|https?://)"
)
_RUN = "array<struct<id:string,start:bigint,end:bigint,text:string>>"


def _runs(paragraph: Column) -> Column:
    """The runs to move of a paragraph (``start, sentences``): ``start`` (where the sentence before ends), ``end`` and ``text``."""
    body = F.col("_text")
    said = lambda s: F.regexp_replace(F.substring(body, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), r"(?U)\s+$", "")
    told = F.transform(paragraph["sentences"], lambda s: F.struct(s["start"].alias("start"), said(s).alias("said")))
    marked = F.transform(told, lambda s, i: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["said"])).alias("end"), ((i > 0) & series.move(s["said"]).isin(*MOVED) & ~s["said"].rlike(DISCLOSURE)).alias("moves"), series.move(s["said"]).alias("move")))

    def of(s: Column) -> Column:
        moves = lambda i: F.coalesce(F.get(s, i)["moves"], F.lit(False))
        first = F.filter(F.transform(s, lambda x, i: F.when(x["moves"] & ~moves(i - 1), i)), lambda i: i.isNotNull())
        last = F.filter(F.transform(s, lambda x, i: F.when(x["moves"] & ~moves(i + 1), i)), lambda i: i.isNotNull())
        runs = F.zip_with(first, last, lambda a, b: F.struct(F.get(s, a - 1)["end"].alias("start"), F.get(s, b)["end"].alias("end"), F.substring(body, (F.get(s, a)["start"] + 1).cast("int"), (F.get(s, b)["end"] - F.get(s, a)["start"]).cast("int")).alias("text")))
        claims = F.exists(s, lambda x: ~x["moves"] & (x["move"] == "claim"))
        return F.when(claims, runs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string>>"))

    return text.let(marked, of)


def proposed(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, proposal, moved`` and the columns to keep (``id, start, end, text`` of each run, in order): the text with a section at its end.

    Of a prose paragraph, sentences that name a source, confidence or a limit move, but for its
    first one, if a claim is left. A text that has the section, or nothing to move, is its own
    proposal; line ends become ``\\n``, and a null text is empty.
    """
    own = ("doc_id", *keep)
    told = documents.select(*own, text.unified(F.col("text")).alias("_text")).select(*own, "_text", editplan.cut("_text", "_paragraphs", lambda p: p.rlike(MAY_MOVE)))
    prose = F.filter("_paragraphs", lambda p: (F.size(p["sentences"]) > 1) & ~F.get(p["sentences"], F.lit(0))["flat"].rlike(NO_PROSE))
    runs = F.flatten(F.transform(prose, _runs))
    named = F.transform(runs, lambda r: F.struct(F.substring(F.sha2(F.concat(r["text"], F.lit("@"), r["start"].cast("string")), 256), 1, 8).alias("id"), r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text"))).cast(_RUN)
    has = F.col("_text").rlike(rf"(?m)^{HEADING}\s*$")
    moved = told.select(*own, "_text", F.explode(F.array(F.when(has, F.array().cast(_RUN)).otherwise(named))).alias("moved"))
    body = text.spliced(F.col("_text"), F.transform("moved", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("[^m-"), m["id"], F.lit("]")).alias("new"))))
    entries = F.array_join(F.transform("moved", lambda m: F.concat(F.lit("[^m-"), m["id"], F.lit("]: "), m["text"])), "\n\n")
    proposal = F.when(F.size("moved") > 0, F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit(f"\n\n{HEADING}\n\n"), entries, F.lit("\n"))).otherwise(F.col("_text"))
    return moved.select(*own, proposal.alias("proposal"), "moved")


def verified(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ok, reasons`` and the columns to keep of proposals (``doc_id, original, proposal``); a null text is empty."""
    own = ("doc_id", *(F.col(c).alias(f"_keep_{c}") for c in keep))
    told = pairs.select(*own, text.unified(F.col("original")).alias("o"), text.unified(F.col("proposal")).alias("p"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    blocks = F.filter(F.split("p", GAP, -1), lambda b: (b.rlike(ENTRY)) | ~((F.trim(b) == HEADING) & ~F.col("o").contains(HEADING)))
    told = told.withColumn("blocks", blocks)
    body, entries = F.filter("blocks", lambda b: ~b.rlike(ENTRY)), F.filter("blocks", lambda b: b.rlike(ENTRY))
    own = ("doc_id", *(f"_keep_{c}" for c in keep))
    told = told.select(*own, "o", F.array_join(body, "\n\n").alias("body"), F.transform(entries, lambda e: F.struct(F.regexp_extract(e, ENTRY, 1).alias("id"), F.regexp_replace(F.regexp_replace(e, ENTRY, ""), r"\n+\z", "").alias("text"))).alias("entries"))
    told = told.select("*", F.regexp_extract_all("body", F.lit(ANCHOR), F.lit(1)).alias("anchors"), F.split("body", ANCHOR, -1).alias("pieces"))
    ids = F.col("entries.id")
    back = lambda a: F.concat(F.lit(" "), F.coalesce(F.get(F.filter("entries", lambda e: e["id"] == a), F.lit(0))["text"], F.lit("")))
    rebuilt = F.array_join(F.zip_with("pieces", F.concat(F.transform("anchors", back), F.array(F.lit(""))), lambda p, e: F.concat(p, e)), "")
    listed = lambda x: F.transform(F.flatten(F.transform(F.split(x, GAP, -1), text.sentences)), flat)
    # paragraphs that stand as they stood hold the same sentences: only the others are cut
    told = told.select("*", F.split("o", GAP, -1).alias("_was"), F.split(F.array_join("pieces", ""), GAP, -1).alias("_is"))
    apart = lambda x, y: F.filter(x, lambda p, i: ~p.eqNullSafe(F.get(y, i)))
    told = told.select("*", apart("_was", F.col("_is")).alias("_gone"), apart("_is", F.col("_was")).alias("_come"))
    cut = lambda x: F.transform(F.flatten(F.transform(x, text.sentences)), flat)
    after = F.concat(cut(F.col("_come")), F.flatten(F.transform("entries", lambda e: listed(e["text"]))))
    repeats = lambda x: F.size(x) > F.size(F.array_distinct(x))
    count = lambda x: F.size(F.filter(F.split(x, GAP, -1), lambda b: F.trim(b) != ""))
    told = told.withColumn("_rebuilt", rebuilt)
    reasons = F.array_compact(F.array(
        F.when(F.size(F.array_except("anchors", ids)) > 0, "an anchor has no entry"),
        F.when(F.size(F.array_except(ids, "anchors")) > 0, "an entry has no anchor"),
        F.when(repeats(F.col("anchors")), "an anchor appears more than once"),
        F.when(repeats(ids), "an entry appears more than once"),
        F.when(F.array_sort(cut(F.col("_gone"))) != F.array_sort(after), "sentences were lost, added, doubled or changed"),
        F.when((F.col("_rebuilt") != F.col("o")) & (flat(F.col("_rebuilt")) != flat(F.col("o"))), "the text does not read as it did with its entries put back"),
        F.when(count(F.col("o")) != count(F.col("body")), "the number of paragraphs changed"),
    ))
    return told.select(*own, reasons.alias("reasons")).select("doc_id", (F.size("reasons") == 0).alias("ok"), "reasons", *(F.col(f"_keep_{c}").alias(c) for c in keep))
