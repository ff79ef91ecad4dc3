"""Voice sheets: what each character would never say, as data, and the lines that do.

A sheet is a row: a name, other names, words and patterns that the character never uses, words
for what it cannot know, habits, and bounds of its sentences. Lines find their sheet by name;
lines of speakers without one are kept, without findings. The sheets are broadcast only if they
are few; patterns are tried before use, and those that could match slowly are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text

SCHEMA = (
    "name string, aliases array<string>, never array<string>, never_patterns array<struct<re:string,msg:string>>, unknown array<struct<terms:array<string>,why:string,unless_group:array<string>>>, "
    "markers array<string>, tics array<string>, least_words int, most_words int, contractions boolean, questions string"
)
#: Names that are broadcast at most; characters of a pattern at most.
MOST_NAMES, LONGEST = 10_000, 300

# Weights of the checks, contractions, quoted speech, what ends a sentence, words.
WEIGHTS = {"never": 3, "knowledge-leak": 3, "never-pattern": 2, "sentence-length": 1, "contractions": 1, "questions": 2}
CONTRACTION = r"(?U)\b\w+(?:n['’]t|['’](?:ll|re|ve|m|d))\b|(?i)\b(?:it|that|there|what|he|she|here)['’]s\b"
QUOTED = r"\"[^\"]*\"|“[^”]*”"
WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
#: A group that repeats and holds a repetition, or a back-reference: matching can take time that grows faster than the text.
SLOW = r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)\s*[+*{]|\\[1-9k]"


def refused(sheets: DataFrame) -> DataFrame:
    """``name, re, reason`` of patterns that are not tried: too long, slow, or no pattern."""
    each = sheets.select("name", F.explode("never_patterns").alias("p")).select("name", F.col("p.re").alias("re"))
    told = each.withColumn("reason", F.when(F.col("re").isNull() | (F.col("re") == ""), "empty").when(F.length("re") > LONGEST, "too long").when(F.col("re").rlike(SLOW), "slow"))
    odd = told.where("reason is not null")
    distinct = [r[0] for r in told.where("reason is null").select("re").distinct().limit(MOST_NAMES + 1).collect()]
    if len(distinct) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} patterns")
    compiler, wrong = sheets.sparkSession._jvm.java.util.regex.Pattern, []
    for p in distinct:
        try:
            compiler.compile(p)
        except Exception:  # noqa: BLE001 (whatever the compiler has against it)
            wrong.append(p)
    return odd.unionByName(told.where(F.col("re").isin(*wrong)).withColumn("reason", F.lit("no pattern")))


def _named(sheets: DataFrame) -> tuple[DataFrame, bool]:
    """The sheets by every name, in capitals, without refused patterns, and whether they are few. Of two sheets of one name the first by its own name counts."""
    bad = refused(sheets).groupBy("name").agg(F.collect_set("re").alias("_bad"))
    kept = sheets.join(bad, "name", "left").withColumn("never_patterns", F.filter("never_patterns", lambda p: ~F.array_contains(F.coalesce("_bad", F.array().cast("array<string>")), p["re"]))).drop("_bad")
    fields = [f.strip().split()[0] for f in "never never_patterns unknown markers tics least_words most_words contractions questions".split()]
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.upper(n)))
    rows = kept.select(F.explode(names).alias("_speaker"), F.struct("name", *fields).alias("sheet"))
    one = rows.groupBy("_speaker").agg(F.min_by("sheet", F.col("sheet.name")).alias("sheet"))
    return one, one.limit(MOST_NAMES + 1).count() <= MOST_NAMES


def with_sheets(lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """The lines (``speaker`` and others) with ``sheet``, null for a speaker without one."""
    named, few = _named(sheets)
    right = F.broadcast(named) if few else named
    return lines.join(right, F.upper("speaker") == F.col("_speaker"), "left").drop("_speaker")


def has(body: Column, phrase: Column) -> Column:
    """Whether a text has a phrase, in any case, that no letter touches."""
    quoted = F.concat(F.lit(r"(?iu)(?<![A-Za-z])\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z])"))
    return F.regexp_like(body, quoted)


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def findings(lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """``line_id, speaker, name`` (of the sheet), ``check, label, weight, excerpt``. lines: ``line_id, speaker, text`` and, for what a group may know, ``group``.

    Quoted speech is another's: only the test of knowledge, and that of a question's end, reads
    it. A null text is empty. A field that is null makes no check.
    """
    told = lines if "group" in lines.columns else lines.withColumn("group", F.lit(None).cast("string"))
    both = with_sheets(told.select("line_id", "speaker", F.coalesce("text", F.lit("")).alias("_whole"), F.col("group").alias("_group")), sheets).where("sheet is not null")
    both = both.withColumn("_own", F.regexp_replace("_whole", QUOTED, " "))
    s, own, whole = (lambda c: F.col(f"sheet.{c}")), F.col("_own"), F.regexp_replace("_whole", r"(?U)\s+$", "")
    tell = lambda check, label, excerpt: F.struct(F.lit(check).alias("check"), label.alias("label"), F.lit(WEIGHTS[check]).alias("weight"), excerpt.alias("excerpt"))
    when = lambda test, check, label, excerpt: F.when(test, F.array(tell(check, F.lit(label) if isinstance(label, str) else label, excerpt))).otherwise(F.array().cast("array<struct<check:string,label:string,weight:int,excerpt:string>>"))
    never = F.transform(F.filter(F.coalesce(s("never"), _none()), lambda w: has(own, w)), lambda w: tell("never", F.lit("a word this character would never use"), w))
    patterns = F.transform(F.filter(F.coalesce(s("never_patterns"), _none("struct<re:string,msg:string>")), lambda p: F.regexp_like(own, p["re"])), lambda p: tell("never-pattern", F.coalesce(p["msg"], F.lit("matches a never pattern")), p["re"]))
    sizes = F.transform(text.sentences(own), lambda x: F.regexp_count(x, F.lit(WORD)))
    out = F.filter(sizes, lambda n: (n < F.coalesce(s("least_words"), F.lit(0))) | (n > F.coalesce(s("most_words"), F.lit(1 << 30))))
    bounds = F.concat(F.lit("sentence length outside "), F.coalesce(s("least_words"), F.lit(0)).cast("string"), F.lit(" to "), F.coalesce(s("most_words"), F.lit(1_000_000)).cast("string"), F.lit(" words"))
    asked = F.right(whole, F.lit(40))
    leaks = F.filter(
        F.transform(F.filter(F.coalesce(s("unknown"), _none("struct<terms:array<string>,why:string,unless_group:array<string>>")), lambda u: ~F.coalesce(F.array_contains(u["unless_group"], F.col("_group")), F.lit(False))), lambda u: F.struct(F.filter(u["terms"], lambda t: has(F.col("_whole"), t)).alias("hit"), u["why"].alias("why"))),
        lambda u: F.size(u["hit"]) > 0,
    )
    known = F.transform(leaks, lambda u: tell("knowledge-leak", F.concat(F.lit("mentions what the character should not know"), F.coalesce(F.concat(F.lit(": "), F.nullif(u["why"], F.lit(""))), F.lit(""))), F.array_join(u["hit"], ", ")))
    every = F.concat(
        never, patterns,
        when(F.size(out) > 0, "sentence-length", bounds, F.array_join(F.transform(out, lambda n: n.cast("string")), ", ")),
        when((s("contractions") == F.lit(False)) & own.rlike(CONTRACTION), "contractions", "uses a contraction; this character speaks in full forms", F.regexp_extract(own, CONTRACTION, 0)),
        when((s("questions") == "never") & own.contains("?"), "questions", "asks a question; this character never does", asked),
        when((s("questions") == "only") & ~F.rtrim(whole, F.lit("\"'”")).endswith("?"), "questions", "ends on a statement; this character speaks only in questions", asked),
        known,
    )
    rows = both.select("line_id", "speaker", F.col("sheet.name").alias("name"), F.explode(every).alias("f"))
    return rows.select("line_id", "speaker", "name", "f.check", "f.label", F.col("f.weight").cast("long").alias("weight"), "f.excerpt")


def usage(lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """``speaker, name, lines, tic_lines, marker_lines``: shares of each speaker's lines with one of its habits, and with a marker of its region; null for speakers without a sheet, who are kept."""
    both = with_sheets(lines.select("speaker", F.coalesce("text", F.lit("")).alias("_t")), sheets)
    any_of = lambda c: F.exists(F.coalesce(F.col(f"sheet.{c}"), _none()), lambda w: has(F.col("_t"), w)).cast("double")
    told = both.select("speaker", F.col("sheet.name").alias("name"), F.when(F.col("sheet").isNotNull(), any_of("tics")).alias("t"), F.when(F.col("sheet").isNotNull(), any_of("markers")).alias("m"))
    return told.groupBy("speaker", "name").agg(F.count("*").alias("lines"), F.avg("t").alias("tic_lines"), F.avg("m").alias("marker_lines"))


def gate(lines: DataFrame, sheets: DataFrame, most: float = 0.25) -> DataFrame:
    """``speaker, lines, flagged, weight, gate``: how many of a speaker's lines have a finding of weight 2 or more; blocked where their share is over ``most``, unknown without a sheet."""
    found = findings(lines, sheets).groupBy("line_id").agg(F.sum("weight").alias("w"), F.max("weight").alias("top"))
    named = with_sheets(lines.select("line_id", "speaker"), sheets).select("line_id", "speaker", F.col("sheet").isNotNull().alias("known"))
    both = named.join(found, "line_id", "left").groupBy("speaker").agg(F.count("*").alias("lines"), F.count_if(F.col("top") >= 2).alias("flagged"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight"), F.first("known").alias("known"))
    return both.select("speaker", "lines", "flagged", "weight", F.when(~F.col("known"), "unknown").when(F.col("flagged") > F.col("lines") * F.lit(most), "blocked").otherwise("ok").alias("gate"))
