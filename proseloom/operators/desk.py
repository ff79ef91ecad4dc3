"""Questions before submission: figures and appeals without a source, text that does not show, parts that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import lines as L
from proseloom.operators import markdown

# Figures, marks of a source, appeals to authority and text that does not show.
NUMBER = r"(?<![\w.])\d+(?:\.\d+)?%|(?<![\w.,])\d{1,3}(?:,\d{3})+(?![\d,])|(?<![\w.])\d+\.\d+(?![\d.])"
CITED = r"\[\d+(?:[,–-]\s*\d+)*\]|\([^()]*\b(?:1[89]|20)\d\d[a-z]?\)|et al\.|https?://|\bdoi:|\b(?:Table|Figure|Fig\.|Section|Appendix)\s+\d"
APPEAL = r"(?i)\b(?:data\s+shows?|studies (?:have )?show(?:n)?|research (?:shows|suggests|indicates)|experts agree|scientists say)\b"
INVISIBLE = "(?<=[A-Za-z0-9])[\\u200b\\u200c\\u200d\\u2060]+(?=[A-Za-z0-9])|(?s)(?<=.)\\ufeff|[\\u202a-\\u202e\\u2066-\\u2069]+|[\\x{e0000}-\\x{e007f}]+"
HIDING = r"(?:(?<![-\w])color\s*:\s*(?:#fff(?:fff)?(?!\w)|white\b)|font-size\s*:\s*0(?:px|em|rem|pt|%)?(?![\w.])|display\s*:\s*none\b|visibility\s*:\s*hidden\b|opacity\s*:\s*0(?:\.0+)?(?![\w.]))"
STYLED = rf"(?i)<[^<>]+style\s*=\s*(?:\"[^\"]*{HIDING}[^\"]*\"|'[^']*{HIDING}[^']*')[^>]*>[^<]*|\\(?:textcolor\{{white\}}\{{[^}}]*\}}|color\{{white\}}[^\n}}]*)"
OWN_COMMENT = r"(?i)writing-(?:profile|allow):"
HEADING = r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"

#: What a venue asks for: sections by a word of their heading.
VENUES = {"none": (), "paper": ("limitations",)}


def _sentences(documents: DataFrame, column: str) -> DataFrame:
    bare = documents.select("doc_id", markdown.without_comments(text.unified(F.col(column))).alias("text"))
    found = L.prose(bare).where(~F.col("raw").rlike(r"^\s*>"))
    return found.select("doc_id", "line", F.posexplode(text.sentences(F.col("raw"))).alias("n", "sentence"))


def claims(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, line, check, match, sentence``: each figure (number-without-source) and each appeal to unnamed authority (unsupported-authority) in a prose sentence that names no source.

    Block quotes, code and comments are left out. A sentence lies within one line.
    """
    bare = _sentences(documents, column).where(~F.col("sentence").rlike("(?U)" + CITED))
    of = lambda check, pattern: F.transform(text.matches(F.col("sentence"), pattern), lambda m: F.struct(F.lit(check).alias("check"), m.alias("match")))
    found = F.concat(of("number-without-source", "(?U)" + NUMBER), of("unsupported-authority", APPEAL))
    rows = bare.select("doc_id", "line", "sentence", F.explode(found).alias("f"))
    return rows.select("doc_id", "line", "f.check", "f.match", "sentence")


def _untagged(span: Column) -> Column:
    """Tag characters (U+E0020 to U+E007E) as the letters that they mirror."""
    return F.translate(span, "".join(chr(0xE0000 + k) for k in range(0x20, 0x7F)), "".join(map(chr, range(0x20, 0x7F))))


def hidden(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, kind, start, end, shown``: spans that a reader does not see: comments (but the library's own marks), invisible characters, text styled away.

    Fenced code and block quotes are left out. ``shown`` spells tag characters out.
    """
    marked = L.with_states(documents, column).withColumn("seen", F.when(F.col("in_fence") | F.col("raw").rlike(r"^\s*>"), F.repeat(F.lit(" "), F.length("raw"))).otherwise(F.col("raw")))
    joined = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "seen"))).alias("rows")).select("doc_id", F.array_join(F.transform("rows", lambda r: r["seen"]), "\n").alias("seen"))
    of = lambda kind, pattern: F.transform(text.all_matches(F.col("seen"), pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _untagged(m["value"]).alias("shown")))
    found = F.concat(F.filter(of("comment", markdown.COMMENT), lambda m: ~m["shown"].rlike(OWN_COMMENT)), of("invisible", INVISIBLE), of("styled", STYLED))
    return joined.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def missing_sections(documents: DataFrame, asked: tuple[str, ...] = VENUES["paper"], column: str = "text") -> DataFrame:
    """``doc_id, section``: sections asked for that no heading of the text names."""
    heads = F.lower(F.array_join(F.regexp_extract_all(text.unified(F.col(column)), F.lit(HEADING), F.lit(1)), " "))
    absent = F.array_compact(F.array(*(F.when(~heads.contains(a), F.lit(a)) for a in asked)))
    return documents.select("doc_id", F.explode(absent).alias("section"))
