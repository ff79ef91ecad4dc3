"""Negation load: how much of a text's clauses say what is not."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text

# Rules (warn, fail, whether dialogue is exempt), markers and clause patterns.
RULES = {"copy": (0.30, 0.50, False), "fiction": (0.45, 0.65, True)}
MIN_WORDS, WEAK_MAX_WORDS = 8, 15
STRONG = (
    r"(?iU)\bnot\b|n['’]t\b|\bcannot\b|\bnever\b|\bnone\b|\bnor\b|\bneither\b|\bnothing\b|\bnobody\b|\bnowhere\b|\bno\b(?!\.?\s*\d)(?!-)|\blimited to\b|\byet to\b|"
    r"\bun(?:measured|verified|tested|proven|signed|released)\b|\bhonest nulls?\b|\bdoes-not-prove\b|\bcaveats?\b|\bdisclaimers?\b|\bout of scope\b"
)
WEAK = r"(?iU)\bwithout\b|(?<![-\w])(?<!not )(?<!the )(?<!if )\bonly\b(?!-)|\bexcept\b|\bunless\b|\bpending\b"
VIRTUE = (
    r"(?iU)\bprovenance\b|\breceipts?\b|\bre-?derivab\w*|\bre-?derive[sd]?\b|\btransparen(?:t|cy)\b|\bhonest(?:y|ly)?\b|\bverifiab\w*|\bverif(?:y|ies|ied) offline\b|\bauditab\w*|"
    r"\binspectab\w*|\btamper-evident\b|\breproducib\w*|\bsigned checksums?\b|\baccountab\w*|\bevidence chains?\b|\bsourced evidence\b|\bwitness(?:ed|ing)?\b"
)
SENTENCE = "(?<=[.!?])[\"'”’)]?\\s+(?=[\"'“(\\[]?[A-Z0-9])"
HARD = r"(?i)\s*;\s*|\s+[–—]\s+|\s+--\s+|—|,?\s+(?=(?:but|while|whereas|although|though|because)\s)"
SOFT = r"(?i),\s+(?=(?:and|so|yet)\s)"
LEAD = r"(?i)^(?:and|but|while|whereas|yet|so|though|although|because)\s+"
ADDRESS = r"(?U)\S*(?:https?://|www\.|[\w-]\.(?:com|io|org|net|dev|html?|md|json)\b)\S*"
SMALL = "a an the of and or to in on for at by is as its with from".split()


def _words(x: Column) -> Column:
    return text.matches(x, text.NEGATION_WORD)


def _begins(letters: str, pattern: str) -> str:
    """The pattern, tried only where one of the letters stands, with which all its matches begin."""
    flags, rest = pattern.split(")", 1)
    if rest.count("|\\b") == re.sub(r"\(\?:[^()]*\)", "", rest).count("|") and rest.startswith("\\b"):  # each begins a word
        rest = "\\b(?:" + rest[2:].replace("|\\b", "|") + ")"
    return f"{flags})(?=[{letters}])(?:{rest})"


#: What an address holds, and the patterns with the letters that begin their matches.
ADDRESSED = ("http", "www.", ".com", ".io", ".org", ".net", ".dev", ".htm", ".md", ".json")
_STRONG, _WEAK, _VIRTUE = _begins("nclyuhdo", STRONG), _begins("woeup", WEAK), _begins("prthvaisew", VIRTUE)


def _bare(entry: Column) -> Column:
    """The entry with a space for each address."""
    return F.when(reduce(or_, (entry.contains(x) for x in ADDRESSED)), F.regexp_replace(entry, ADDRESS, " ")).otherwise(entry)


def _soft_split(part: Column) -> Column:
    """Cuts at ", and" where four or more words stand on either side, so that a list keeps its last item."""

    def add(state: Column, piece: Column) -> Column:
        left = F.element_at(F.split(F.element_at(state["out"], -1), ","), -1)
        right = F.element_at(F.split(piece, ","), 1)
        cut = (F.size(_words(left)) >= 4) & (F.size(_words(right)) >= 4)
        joined = F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(F.concat(F.element_at(state["out"], -1), state["sep"], piece)))
        return F.struct(F.when(cut, F.concat(state["out"], F.array(piece))).otherwise(joined).alias("out"), state["sep"].alias("sep"))

    def joined(pieces: Column) -> Column:
        start = F.struct(F.array(F.element_at(pieces, 1)).alias("out"), F.lit(", ").alias("sep"))
        return F.when(F.size(pieces) > 1, F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), start, add)["out"]).otherwise(pieces)

    return F.when(part.contains(","), text.let(text.pieces(part, SOFT), joined)).otherwise(F.array(part))


def _clauses(bare: Column) -> Column:
    """The clauses of an entry without addresses, as ``struct<p, n>``: each with the number of its words, which are found once."""
    sentences = text.pieces(F.trim(bare), SENTENCE)
    hard = F.flatten(F.transform(sentences, lambda s: text.pieces(s, HARD)))
    parts = F.transform(F.flatten(F.transform(hard, _soft_split)), lambda p: F.regexp_replace(F.trim(p), LEAD, ""))
    content = lambda w: F.filter(w, lambda x: ~F.lower(x).isin(*SMALL) & x.rlike("^[A-Za-z]"))
    titled = lambda c: (F.size(c) >= 2) & (F.size(F.filter(c, lambda w: w.rlike("^[A-Z]"))) / F.greatest(F.size(c), F.lit(1)) >= 0.75)
    told = lambda p: text.let(_words(p), lambda w: F.struct(p.alias("p"), F.size(w).alias("n"), F.when(F.size(w) >= 2, text.let(content(w), titled)).alias("titled")))
    return F.transform(F.filter(F.transform(parts, told), lambda c: (c["n"] >= 2) & ~c["titled"]), lambda c: F.struct(c["p"].alias("p"), c["n"].alias("n")))


def clauses(entry: Column) -> Column:
    """The clauses of an entry of two words or more; titles in title case are left out."""
    return F.transform(_clauses(_bare(entry)), lambda c: c["p"])


def negates(clause: Column, words: Column | None = None) -> Column:
    """words: the number of the clause's words, if it is at hand."""
    return clause.rlike(_STRONG) | (((F.size(_words(clause)) if words is None else words) <= WEAK_MAX_WORDS) & clause.rlike(_WEAK))


def load(entries: DataFrame, rule: str = "copy") -> DataFrame:
    """The entries (``entry_id, text`` and an optional ``dialogue`` flag) of eight words or more with ``score, word_share, clauses, negation_clauses, words, virtue, verdict``."""
    warn, fail, exempt = RULES[rule]
    if exempt and "dialogue" in entries.columns:
        entries = entries.where(~F.coalesce("dialogue", F.lit(False)))
    body = F.coalesce(F.col("text"), F.lit(""))
    read = entries.select("*", _bare(body).alias("bare")).withColumn("words", F.size(_words(F.col("bare"))).cast("long"))
    negative = read.withColumn("parts", _clauses(F.col("bare"))).withColumn("negative", F.filter("parts", lambda c: negates(c["p"], c["n"])))
    total = lambda c: F.aggregate(F.transform(c, lambda p: p["n"]), F.lit(0), lambda a, x: a + x)
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    told = negative.where(F.col("words") >= MIN_WORDS).select(
        "entry_id",
        share(F.size("negative").cast("double"), F.size("parts")).alias("score"),
        share(total("negative").cast("double"), total("parts")).alias("word_share"),
        F.size("parts").cast("long").alias("clauses"),
        F.size("negative").cast("long").alias("negation_clauses"),
        "words",
        text.count(F.col("bare"), _VIRTUE).alias("virtue"),
    )
    rounded = F.round("score", 3)
    return told.withColumn("verdict", F.when(rounded >= fail, "fail").when(rounded >= warn, "warn").otherwise("ok"))


def summary(loads: DataFrame) -> DataFrame:
    """One row: entries, and how many are ok, warn, fail, and use virtue words."""
    return loads.agg(F.count("*").alias("entries"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "warn", "fail")), F.count_if(F.col("virtue") > 0).alias("virtue_entries"))
