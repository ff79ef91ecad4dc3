"""Documents to physical lines, prose lines and sentence rows.

Lines are cut and placed inside the row, so each of several rows of one doc_id gives its own
lines. States that look around are told there too (``with_states``); ``states`` tells them of
lines at hand, by windows over a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import rules, text
from proseloom.sources.tables import written


def _by_line(key: str = "doc_id"):
    return Window.partitionBy(key).orderBy("line")


def masked(frame: DataFrame, column: str, into: str) -> DataFrame:
    """The frame with ``into``: the column with markup blanked.

    One projection for each mask, so that none is nested in the next; the generator at the end
    keeps later filters from being pushed through them, which would repeat the masks in each.
    """
    frame = frame.withColumn(into, F.col(column))
    for pattern, needs in zip(text.MARKUP, text.MARKUP_NEEDS, strict=True):
        frame = frame.withColumn(into, text.blanked(F.col(into), pattern, needs))
    return frame.select(*(c for c in frame.columns if c != into), F.explode(F.array(into)).alias(into))


def lines(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, line`` (from 1), ``start`` (offset in the text with ``\\n`` line ends), ``raw`` (without its line end).

    A line end at the end of a text opens no further line; an empty text has no line. Other
    separators than CR, LF and CRLF stay within a line.
    """
    body = text.unified(F.col(column))
    split = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1))
    placed = text.let(split, lambda raws: F.arrays_zip(text.starts(F.transform(raws, lambda r: F.length(r) + 1)).alias("start"), raws.alias("raw")))
    return documents.select("doc_id", F.posexplode(placed).alias("pos", "l")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), "l.start", "l.raw")


def source_lines(column: Column) -> Column:
    """The lines of a text as an array of ``struct<start, raw, rest>``: where each begins in the text as it is, the line, and its line end (CR, LF, CRLF or none)."""
    body = F.coalesce(column, F.lit(""))
    end = "\r\n?|\n"

    def placed(raws: Column) -> Column:
        ends = F.zip_with(raws, text.matches(body, end), lambda r, e: F.struct(r.alias("raw"), F.coalesce(e, F.lit("")).alias("rest")))
        return text.let(ends, lambda e: F.zip_with(e, text.starts(F.transform(e, lambda x: F.length(x["raw"]) + F.length(x["rest"]))), lambda x, at: F.struct(at.alias("start"), x["raw"].alias("raw"), x["rest"].alias("rest"))))

    return F.filter(text.let(F.split(body, end, -1), placed), lambda x: (x["raw"] != "") | (x["rest"] != ""))


def states(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines of each key with ``in_fence`` (fence lines included) and ``front`` (YAML front matter, its marks included).

    A fence mark toggles; front matter opens on a first line ``---`` and closes at the next
    such line outside a fence.
    """
    mark = F.col("raw").rlike(rules.FENCE)
    fences = F.sum(mark.cast("int")).over(_by_line(key).rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("in_fence", mark | (fences % 2 == 1))
    dash = F.trim("raw") == "---"
    opens = F.max(((F.col("line") == 1) & dash).cast("int")).over(Window.partitionBy(key)) == 1
    close = F.min(F.when((F.col("line") > 1) & dash & ~F.col("in_fence"), F.col("line"))).over(Window.partitionBy(key))
    return found.withColumn("front", opens & (F.col("line") <= F.coalesce(close, F.lit((1 << 62)))))


def _states(raws: Column) -> Column:
    """``in_fence`` and ``front``, as ``states`` tells them, of each of the lines of a text."""

    def fenced(marks: Column) -> Column:
        return F.zip_with(marks, text.starts(F.transform(marks, lambda m: m.cast("long"))), lambda m, before: m | (before % 2 == 1))

    def front(inside: Column) -> Column:
        close = F.array_min(F.transform(raws, lambda r, i: F.when((i > 0) & (F.trim(r) == "---") & ~F.get(inside, i), i)))
        last = F.when(F.trim(F.get(raws, F.lit(0))) == "---", F.coalesce(close, F.size(raws))).otherwise(-1)
        return text.let(last, lambda n: F.transform(inside, lambda x, i: F.struct(x.alias("in_fence"), (i <= n).alias("front"))))

    may = F.exists(raws, lambda r: r.contains("```") | r.contains("~~~"))
    marks = text.let(F.transform(raws, lambda r: r.rlike(rules.FENCE)), fenced)
    return text.let(F.when(may, marks).otherwise(F.transform(raws, lambda r: F.lit(False))), front)


def with_states(documents: DataFrame, column: str = "text") -> DataFrame:
    """``lines`` with their ``states``, which are found inside the row: no line is shuffled, and rows of one doc_id stay apart."""
    body = text.unified(F.col(column))
    split = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1))
    placed = text.let(split, lambda raws: F.arrays_zip(text.starts(F.transform(raws, lambda r: F.length(r) + 1)).alias("start"), raws.alias("raw"), _states(raws).alias("s")))
    return documents.select("doc_id", F.posexplode(placed).alias("pos", "l")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), "l.start", "l.raw", "l.s.in_fence", "l.s.front")


def marked(documents: DataFrame, column: str = "text") -> DataFrame:
    """All lines with their states and ``masked``, written once for those that read them again and again; a line that is no prose has no mask."""
    found = with_states(documents, column).withColumn("_prose", F.when(~F.col("in_fence") & ~F.col("front"), F.col("raw")))
    found = masked(found, "_prose", "_masked").withColumn("_other", F.nullif(F.col("_masked"), F.col("raw")))
    kept = written(found.select("doc_id", "line", "start", "raw", "in_fence", "front", "_other"), "marked-lines")
    return kept.select("doc_id", "line", "start", "raw", "in_fence", "front", F.coalesce("_other", "raw").alias("masked"))


def prose(documents: DataFrame, column: str = "text", told: DataFrame | None = None) -> DataFrame:
    """Lines outside fences and front matter, with ``masked`` (markup blanked, same length). told: what ``marked`` gave for these documents."""
    if told is not None:
        return told.where("not in_fence and not front").select("doc_id", "line", "start", "raw", "masked")
    kept = with_states(documents, column).where("not in_fence and not front")
    return masked(kept.select("doc_id", "line", "start", "raw"), "raw", "masked")


def sentence_rows(found: DataFrame) -> DataFrame:
    """Sentences of at least three words of prose lines: ``doc_id, line, n`` (place in the line), ``sentence``, ``words`` (count)."""
    pieces = found.where(~F.col("raw").rlike(rules.RULE_LINE)).select("doc_id", "line", F.posexplode(F.split("masked", r"(?U)(?<=[.!?])\s+", -1)).alias("n", "sentence"))
    trimmed = pieces.select("doc_id", "line", "n", F.regexp_replace("sentence", r"(?U)^\s+|\s+$", "").alias("sentence"))
    return trimmed.withColumn("words", text.count(F.col("sentence"), text.WORD)).where("words >= 3")
