"""Series review: what many documents of one series share, and how even each one is."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import rules, text
from proseloom.operators import lines as L
from proseloom.sources.tables import written

# Thresholds of the series checks.
NGRAM, NGRAM_DOCS, NGRAM_REPORT = 4, 3, 10
CONSTRUCTION_SHARE, HEADING_SHARE = 0.5, 0.5
SECTIONS, SECTION_CV = 4, 0.20
RHYTHM_SENTENCES, RHYTHM_CV, RHYTHM_SPREAD, RHYTHM_BAND, RHYTHM_RUN = 20, 0.45, 0.05, 6, 8
PERSPECTIVE_WORDS, PERSPECTIVE_RATE, PERSPECTIVE_STRETCH = 300, 1.0, 1500
TEMPLATE_DOCS, TEMPLATE_LITERALS, TEMPLATE_REPORT = 3, 3, 12
ABSTRACT_RUN, ABSTRACT_WORDS = 3, 20
SCAFFOLD_SHARE, SCAFFOLD_PARAGRAPHS, SCAFFOLD_DOCS = 0.40, 5, 3
SPECIFIC = r"\d[\d,.:/]*|\"[^\"\n]{3,}\"|“[^”]{3,}”"
MOVES = (
    ("limit", r"(?i)\bdoes(?: not|n't) (?:prove|show|establish)\b|\bwhat this does not\b|\bdoes-not-prove\b|\bthis is not evidence\b"),
    ("confidence", r"(?i)\bconfidence\b|[(\[:]\s*(?:high|moderate|low|unknown)\b|^\W*(?:high|moderate|low|unknown)\W*$"),
    ("source", r"(?i)https?://|\]\(|\baccording to\b|\breport(?:ed|s)\b|\bsources?:|\[\d+\]|\[\^[^\]]+\]|\bper the\b"),
    ("first-person", r"^\W*(?:I|My|We|Our)\b|\bI\b|\b(?:me|my|mine|myself)\b"),
    ("question", r"\?[\"'”’)\]]*$"),
    ("example", r"(?i)\bfor (?:example|instance)\b|\be\.g\.|\d[\d,.]*\s?(?:%|percent|kg|km|miles?|words|people|years?|days?|hours?|months?|dollars|million|billion)\b|\$\d"),
)
FIRST_PERSON = r"\bI\b|\b(?:[Mm]e|[Mm]y|[Mm]ine|[Mm]yself)\b|\b(?:[Ww]e|[Uu]s|[Oo]ur|[Oo]urs|[Oo]urselves)\b"


def cv(values: str) -> Column:
    """Population deviation over mean; null for fewer than two values or a zero mean."""
    return F.when((F.count(values) >= 2) & (F.avg(values) != 0), F.stddev_pop(values) / F.avg(values))


def blocks(documents: DataFrame) -> DataFrame:
    """Blank-line blocks: ``doc_id, block, kind`` (heading, list, quote, table, comment, prose), ``line_start, line_end, text``; headings stand alone."""
    marked = L.with_states(documents).where("not front")
    order = Window.partitionBy("doc_id").orderBy("line")
    raw = F.col("raw")
    kind = (
        F.when(raw.rlike(rules.HEADING), "heading").when(raw.rlike(rules.BULLET), "list").when(raw.rlike(r"^\s*>"), "quote").when(raw.rlike(r"^\s*\|"), "table").when(raw.rlike(r"^\s*<!--"), "comment").otherwise("prose")
    )
    gap = F.col("in_fence") | (F.trim("raw") == "")
    told = marked.select("doc_id", "line", "raw", gap.alias("gap"), kind.alias("kind"))
    first = F.coalesce(F.lag("gap").over(order), F.lit(True)) | (F.col("kind") == "heading") | (F.lag("kind").over(order) == "heading")
    numbered = told.withColumn("block", F.sum((~F.col("gap") & first).cast("long")).over(order)).where("not gap")
    rows = F.array_sort(F.collect_list(F.struct("line", "raw", "kind")))
    grouped = numbered.groupBy("doc_id", "block").agg(rows.alias("rows"))
    return grouped.select("doc_id", "block", F.element_at("rows", 1)["kind"].alias("kind"), F.element_at("rows", 1)["line"].alias("line_start"), F.element_at("rows", -1)["line"].alias("line_end"), F.array_join(F.transform("rows", lambda r: r["raw"]), "\n").alias("text"))


def sections(documents: DataFrame) -> DataFrame:
    """``doc_id, section, heading, line, words``: headings of level 2 or deeper with the words of prose, lists and quotes under them."""
    found = blocks(documents)
    order = Window.partitionBy("doc_id").orderBy("block")
    opens = (F.col("kind") == "heading") & ~F.ltrim("text").startswith("# ")
    told = found.withColumn("section", F.sum(opens.cast("long")).over(order)).where("section > 0")
    told = L.masked(told, "text", "masked")
    counted = F.when(F.col("kind").isin("prose", "list", "quote"), text.count(F.col("masked"), text.WORD)).otherwise(0)
    grouped = told.withColumns({"opens": opens, "n": counted}).groupBy("doc_id", "section")
    return grouped.agg(F.max(F.when(F.col("opens"), F.trim("text"))).alias("heading"), F.min("line_start").alias("line"), F.sum("n").alias("words"))


def heading_key(heading: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(heading, r"^\s*#+\s*", ""), r"(?i)^\s*(?:\d+[.)]|[ivx]+\.)\s*", "")
    return F.array_join(text.matches(F.lower(bare), "[a-z0-9']+"), " ")


def even_sections(documents: DataFrame) -> DataFrame:
    """``doc_id, sections, cv`` of documents whose sections are nearly equally long."""
    agg = sections(documents).groupBy("doc_id").agg(F.count("*").alias("sections"), cv("words").alias("cv"))
    return agg.where((F.col("sections") >= SECTIONS) & (F.col("cv") < SECTION_CV))


def heading_overlap(documents: DataFrame, share: float = HEADING_SHARE) -> DataFrame:
    """``heading, docs`` of headings that at least half of the documents use."""
    total = documents.select("doc_id").distinct().agg(F.count("*").alias("total"))
    used = sections(documents).select("doc_id", heading_key(F.col("heading")).alias("heading")).where("heading != ''").distinct().groupBy("heading").agg(F.count("*").alias("docs"))
    return used.join(F.broadcast(total)).where((F.col("docs") >= 2) & (F.col("docs") / F.col("total") >= share)).select("heading", "docs")  # total is one row


def rhythm(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, sentences, cv, flat``: sentence-length variation; flat where many sentences vary little."""
    pieces = documents.select("doc_id", F.explode(text.sentences(F.coalesce(F.col(column), F.lit("")))).alias("s"))
    lengths = pieces.select("doc_id", text.count(F.col("s"), text.WORD).alias("n")).where("n > 0")
    agg = lengths.groupBy("doc_id").agg(F.count("*").alias("sentences"), cv("n").alias("cv"))
    return agg.withColumn("flat", F.coalesce((F.col("sentences") >= RHYTHM_SENTENCES) & (F.col("cv") < RHYTHM_CV), F.lit(False)))


def rhythm_spread(documents: DataFrame, column: str = "text") -> DataFrame:
    """One row: ``docs, spread, same``: whether three or more documents vary by nearly the same amount."""
    measured = rhythm(documents, column).where(F.col("sentences") >= RHYTHM_SENTENCES).where("cv is not null")
    agg = measured.agg(F.count("*").alias("docs"), (F.max("cv") - F.min("cv")).alias("spread"))
    return agg.withColumn("same", F.coalesce((F.col("docs") >= 3) & (F.col("spread") <= RHYTHM_SPREAD), F.lit(False)))


def perspective(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, words, first_person, per_1k, low``: first-person words outside quotes."""
    body = text.without_quotes(F.coalesce(F.col(column), F.lit("")))
    told = documents.select("doc_id", text.count(F.coalesce(F.col(column), F.lit("")), text.WORD).alias("words"), text.count(body, FIRST_PERSON).alias("first_person"))
    rate = F.when(F.col("words") > 0, F.col("first_person") * 1000.0 / F.col("words")).otherwise(0.0)
    return told.withColumn("per_1k", rate).withColumn("low", (F.col("words") >= PERSPECTIVE_WORDS) & (F.col("per_1k") < PERSPECTIVE_RATE))


def _prose(documents: DataFrame) -> DataFrame:
    """Prose blocks with ``words``, counted without markup."""
    return L.masked(blocks(documents).where("kind = 'prose'"), "text", "masked").withColumn("words", text.count(F.col("masked"), text.WORD))


def _runs(rows: DataFrame, broken: Column) -> DataFrame:
    """Numbers the runs of rows of a document between broken ones, which are dropped."""
    order = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_broken", broken).withColumn("run", F.sum(F.col("_broken").cast("long")).over(order)).where(~F.col("_broken"))


def author_stretches(documents: DataFrame, least: int = PERSPECTIVE_STRETCH) -> DataFrame:
    """``doc_id, words, line_start, line_end``: runs of prose blocks without a first-person word outside quotes, of at least so many words."""
    agg = _runs(_prose(documents), text.without_quotes(F.col("text")).rlike(FIRST_PERSON)).groupBy("doc_id", "run").agg(F.sum("words").alias("words"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return agg.where(F.col("words") >= least).select("doc_id", "words", "line_start", "line_end")


def abstract_runs(documents: DataFrame, least: int = ABSTRACT_RUN) -> DataFrame:
    """``doc_id, paragraphs, line_start, line_end``: runs of prose blocks of ABSTRACT_WORDS words or more with no number, quotation or capitalised word inside a sentence; shorter blocks neither count nor break."""
    inner = F.exists(text.sentences(F.col("masked")), lambda s: F.regexp_replace(s, "^[^A-Za-z]+", "").rlike(r".\b[A-Z][a-z][A-Za-z'-]*"))
    specific = F.col("text").rlike(SPECIFIC) | inner
    agg = _runs(_prose(documents).where(F.col("words") >= ABSTRACT_WORDS), specific).groupBy("doc_id", "run").agg(F.count("*").alias("paragraphs"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return agg.where(F.col("paragraphs") >= least).select("doc_id", "paragraphs", "line_start", "line_end")


def band_runs(documents: DataFrame, band: int = RHYTHM_BAND, column: str = "text") -> DataFrame:
    """``doc_id, run, first``: the longest run of sentences whose lengths in words differ by at most the band, and where it starts (from 0, the first of equal ones).

    Two moving ends, linear in the sentences: monotone queues hold the largest and smallest length.
    """
    lengths = F.filter(F.transform(text.sentences(F.coalesce(F.col(column), F.lit(""))), lambda s: text.count(s, text.WORD)), lambda n: n > 0)

    @F.pandas_udf("struct<run:long,first:long>")
    def longest(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            high, low, start, best = deque(), deque(), 0, (0, 0)
            for end, n in enumerate(row):
                while high and row[high[-1]] <= n:
                    high.pop()
                while low and row[low[-1]] >= n:
                    low.pop()
                high.append(end)
                low.append(end)
                while row[high[0]] - row[low[0]] > band:
                    start += 1
                    for q in (high, low):
                        if q[0] < start:
                            q.popleft()
                if end - start + 1 > best[0]:
                    best = (end - start + 1, start)
            out.append(best)
        return pd.DataFrame(out, columns=["run", "first"])

    return documents.select("doc_id", longest(lengths).alias("r")).select("doc_id", "r.run", "r.first")


def move(sentence: Column) -> Column:
    """What a sentence does: the first of MOVES that it fits, or claim."""

    def first(flat: Column) -> Column:
        told = F.lit("claim")
        for name, pattern in reversed(MOVES):
            told = F.when(flat.rlike(pattern), name).otherwise(told)
        return told

    return text.let(F.trim(F.regexp_replace(sentence, r"\s+", " ")), first)


def moves(documents: DataFrame) -> DataFrame:
    """``doc_id, block, line_start, seq``: what the sentences of each prose block of two or more do, repeats in a row as one."""
    labelled = blocks(documents).where("kind = 'prose'").select("doc_id", "block", "line_start", F.transform(text.sentences(F.col("text")), move).alias("all")).where(F.size("all") >= 2)
    changed = F.filter("all", lambda m, i: (i == 0) | (m != F.get("all", F.greatest(i - 1, F.lit(0)))))
    return labelled.select("doc_id", "block", "line_start", changed.alias("seq"))


def scaffold_share(documents: DataFrame, paragraphs: int = SCAFFOLD_PARAGRAPHS, share: float = SCAFFOLD_SHARE) -> DataFrame:
    """``doc_id, paragraphs, scaffold, share``: documents of which so large a share of the paragraphs ends on a limit or a statement of confidence."""
    ends = F.element_at("seq", -1).isin("limit", "confidence") & (F.size("seq") > 1)
    agg = moves(documents).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(ends).alias("scaffold")).withColumn("share", F.col("scaffold") / F.col("paragraphs"))
    return agg.where((F.col("paragraphs") >= paragraphs) & (F.col("share") >= share))


def shared_sequences(documents: DataFrame, least: int = SCAFFOLD_DOCS) -> DataFrame:
    """``sequence, docs``: three moves in a row, two of them sources, limits or confidence, that so many documents make."""
    windows = moves(documents).select("doc_id", F.explode(text.grams(F.col("seq"), 3)).alias("w"))
    held = windows.where(F.size(F.filter("w", lambda m: m.isin("source", "confidence", "limit"))) >= 2).distinct()
    return held.groupBy(F.array_join("w", " ").alias("sequence")).agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def shared_ngrams(documents: DataFrame, n: int = NGRAM, least: int = NGRAM_DOCS, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``gram, docs``: word n-grams with two content words that at least ``least`` documents hold.

    Each document counts once. A long shared passage gives all its n-grams; ``maximal_ngrams`` joins them.
    """
    tokens = F.transform(text.words(F.coalesce(F.col(column), F.lit(""))), lambda w: F.lower(w))
    grams = documents.select(F.col(key).alias("k"), tokens.alias("t")).select("k", F.explode(F.array_distinct(F.transform(text.grams(F.col("t"), n), lambda g: g))).alias("g"))
    content = grams.where(F.size(F.filter("g", lambda w: ~w.isin(*rules.NGRAM_STOP))) >= 2)
    return content.groupBy(F.array_join("g", " ").alias("gram")).agg(F.count_distinct("k").alias("docs")).where(F.col("docs") >= least)


def maximal_ngrams(documents: DataFrame, n: int = NGRAM, least: int | None = None, report: int = NGRAM_REPORT) -> DataFrame:
    """``passage, words, docs``: runs of shared n-grams joined to maximal passages, the most shared first (a top-``report`` list).

    A passage counts every document that holds it, inside a longer run too; one that lies in
    another of at least as many documents is left out. least: NGRAM_DOCS, or 2 for at most
    three documents.
    """
    if least is None:
        least = NGRAM_DOCS if documents.select("doc_id").distinct().limit(4).count() > 3 else 2
    shared = shared_ngrams(documents, n, least).select("gram")
    tokens = F.transform(text.words(F.coalesce(F.col("text"), F.lit(""))), lambda w: F.lower(w))
    placed = documents.select("doc_id", tokens.alias("t")).select("doc_id", F.posexplode(text.grams(F.col("t"), n)).alias("at", "g")).select("doc_id", "at", F.array_join("g", " ").alias("gram"), F.element_at("g", -1).alias("last"))
    hits = placed.join(shared, "gram")
    order = Window.partitionBy("doc_id").orderBy("at")
    apart = F.coalesce((F.col("at") > F.lag("at").over(order) + 1).cast("int"), F.lit(1))
    islands = hits.withColumn("new", apart).withColumn("island", F.sum("new").over(order))
    rows = F.array_sort(F.collect_list(F.struct("at", "gram", "last")))
    words = F.concat(F.split(F.element_at("r", 1)["gram"], " "), F.transform(F.slice("r", 2, F.greatest(F.size("r"), F.lit(1))), lambda x: x["last"]))
    runs = written(islands.groupBy("doc_id", "island").agg(rows.alias("r")).select("doc_id", words.alias("w"), F.transform("r", lambda x: x["gram"]).alias("grams")), "shared-runs")
    passages = runs.groupBy("w").agg(F.first("grams").alias("grams"))

    def inside(of: DataFrame, *keep: str) -> DataFrame:
        """``w`` and what is kept of ``of`` (``w, grams``), for all runs of ``of`` that hold the passage w."""
        at = of.select(*keep, F.col("w").alias("whole"), F.posexplode("grams").alias("at", "gram"))
        heads = passages.select("w", F.element_at("grams", 1).alias("gram"))
        return at.join(heads, "gram").where(F.slice("whole", F.col("at") + 1, F.size("w")) == F.col("w")).select("w", "whole", *keep)

    counted = written(inside(runs, "doc_id").groupBy("w").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= least), "passages")
    longer = inside(passages.join(counted, "w"), "docs").where(F.size("whole") > F.size("w")).groupBy("w").agg(F.max("docs").alias("around"))
    maximal = counted.join(longer, "w", "left").where(F.col("around").isNull() | (F.col("around") < F.col("docs")))
    told = maximal.select(F.array_join("w", " ").alias("passage"), F.size("w").cast("long").alias("words"), "docs")
    return told.orderBy(F.desc("docs"), F.desc("words"), "passage").limit(report)


def shared_constructions(findings: DataFrame, documents: DataFrame, share: float = CONSTRUCTION_SHARE) -> DataFrame:
    """``category, docs, share``: finding categories that at least two and half of the documents show."""
    total = documents.select("doc_id").distinct().agg(F.count("*").alias("total"))
    agg = findings.groupBy("category").agg(F.count_distinct("doc_id").alias("docs")).join(F.broadcast(total))  # one row
    return agg.where((F.col("docs") >= 2) & (F.col("docs") / F.col("total") >= share)).select("category", "docs", (F.col("docs") / F.col("total")).alias("share"))


def sentence_templates(documents: DataFrame, least: int = TEMPLATE_DOCS, report: int = TEMPLATE_REPORT) -> DataFrame:
    """``template, docs``: sentence openings of function words and word endings that several documents use (a top-``report`` list).

    A word that is no function word stands as ``_``; a template needs three literal words.
    """
    pieces = documents.select("doc_id", F.explode(text.sentences(F.coalesce(F.col("text"), F.lit("")))).alias("s"))
    shape = F.transform(text.words(F.col("s")), lambda w: F.when(F.lower(w).isin(*rules.NGRAM_STOP), F.lower(w)).otherwise("_"))
    grams = pieces.select("doc_id", shape.alias("w")).select("doc_id", F.explode(F.concat(*(text.grams(F.col("w"), n) for n in range(3, 7)))).alias("g"))
    literal = grams.where(F.size(F.filter("g", lambda w: w != "_")) >= TEMPLATE_LITERALS)
    agg = literal.groupBy(F.array_join("g", " ").alias("template")).agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= least)
    return agg.orderBy(F.desc("docs"), "template").limit(report)


def title(column: Column) -> Column:
    """Front matter ``title:``, else the first level-1 heading, else an HTML title; null without any."""
    found = (r"(?ms)\A---\n.*?^title:\s*[\"']?([^\n\"']+)", r"(?m)^#\s+(.+?)\s*$", r"(?is)<title[^>]*>\s*([^<]+?)\s*</title>")
    return F.coalesce(*(F.when(column.rlike(p), F.trim(F.regexp_extract(column, p, 1))) for p in found))


def title_families(documents: DataFrame, least: int = 2, share: float = 0.30) -> DataFrame:
    """``family, titles, share``: titles of one form (function words kept, other words as ``_``) used by several documents."""
    titles = documents.select(title(F.coalesce(F.col("text"), F.lit(""))).alias("title")).where("title is not null").distinct()
    shape = F.array_join(F.transform(text.words(F.col("title")), lambda w: F.when(F.lower(w).isin(*rules.NGRAM_STOP), F.lower(w)).otherwise("_")), " ")
    total = titles.agg(F.count("*").alias("total"))
    agg = titles.groupBy(shape.alias("family")).agg(F.count("*").alias("titles")).join(F.broadcast(total))  # one row
    return agg.where((F.col("titles") >= least) & (F.col("titles") / F.col("total") >= share)).select("family", "titles", (F.col("titles") / F.col("total")).alias("share"))
