"""Reversible masks: spans that a rewrite must not touch stand as tokens, and come back after it.

A token names its document by a digest of the text and its span by a number, so none can be
taken for text, or for a token of another document. The spans are a table beside the masked
text. After a rewrite each token has a verdict; a paragraph whose tokens are not what they were,
in their order, is refused and stands as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import text

#: Spans by kind; of overlapping ones the outermost counts, of equal ones the first kind.
KINDS = {
    "html": r"(?is)<(script|style|pre)\b[^>]*>.*?</\1\s*>|<!--.*?-->|</?[a-z!][^<>]*>",
    "math": r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)",
    "code": r"(?s)```.*?(?:```|\z)|`[^`\n]+`",
    "url": r"https?://[^\s<>\"')\]]+|(?<![\w.+-])[\w.+-]{1,64}+@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}",
}
OPEN, CLOSE, NAME = "⦃", "⦄", "MASK_"
PARAGRAPH = r"\n\s*\n"
_SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def spans(body: Column, kinds: tuple[str, ...]) -> Column:
    """The spans to mask, apart from each other and in order."""

    def of(kind: str) -> Column:
        return F.transform(text.all_matches(body, KINDS[kind]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("to"), F.lit(kind).alias("kind"), m["value"].alias("value")))

    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(_SPAN).alias("out"))

    def add(held: Column, s: Column) -> Column:
        end = -s["to"]
        one = F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
        return F.when(s["start"] >= held["end"], F.struct(end.alias("end"), F.concat(held["out"], F.array(one)).alias("out"))).otherwise(held)

    if len(kinds) == 1:  # matches of one kind are apart
        return F.transform(text.all_matches(body, KINDS[kinds[0]]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kinds[0]).alias("kind"), m["value"].alias("value")))
    return F.aggregate(F.array_sort(F.concat(*map(of, kinds))), start, add, lambda held: held["out"])


def masked(documents: DataFrame, kinds: tuple[str, ...] = ("html", "math", "code", "url"), key: str = "doc_id", column: str = "text") -> DataFrame:
    """The key, ``masked`` (the text with tokens), ``prefix`` (of the tokens) and ``spans`` (``start, end, kind, value``; the n-th is token n, from 0). A null text is empty."""
    body = F.coalesce(F.col(column), F.lit(""))
    told = documents.select(key, body.alias("_body"), spans(body, kinds).alias("spans"))
    name = F.concat(F.lit(NAME), F.substring(F.sha2("_body", 256), 1, 16))
    # a text that holds the name of its own tokens, however many underscores follow, gets a longer one
    runs = F.transform(F.split("_body", name), lambda p, i: F.when(i > 0, F.length(F.regexp_extract(p, "^_*", 0))))
    prefix = F.when(F.contains("_body", name), F.concat(name, F.repeat(F.lit("_"), F.array_max(runs) + 1))).otherwise(name)
    told = told.withColumn("prefix", prefix)
    token = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(OPEN), F.col("prefix"), F.lit("_"), i.cast("string"), F.lit(CLOSE)).alias("new"))
    return told.select(key, text.spliced(F.col("_body"), F.transform("spans", token)).alias("masked"), "prefix", "spans")


def _token(prefix: Column) -> Column:
    return F.concat(F.lit(OPEN), prefix, F.lit(r"_(\d+)" + CLOSE))


def _numbers(body: Column, prefix: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, _token(prefix), F.lit(1)), lambda n: n.cast("long"))


def _paragraphs(body: Column) -> Column:
    """Paragraphs and what parts them, in turn."""
    gaps = F.concat(text.matches(body, PARAGRAPH), F.array(F.lit("")))
    return F.zip_with(F.split(body, PARAGRAPH, -1), gaps, lambda p, g: F.struct(p.alias("body"), g.alias("gap")))


def verdicts(kept: DataFrame, rewrites: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, mask, kind, verdict`` of every mask: kept, lost, doubled, moved (to another paragraph), reordered (within its own) or, for a token that the text never had, foreign.

    kept: ``masked``; rewrites: the key and a text; a mask of a text without a rewrite is lost.
    """
    both = kept.join(rewrites.select(key, F.coalesce(F.col(column), F.lit("")).alias("_new")), key, "left")
    listed = lambda body: F.flatten(F.transform(F.split(body, PARAGRAPH, -1), lambda p, i: F.transform(_numbers(p, F.col("prefix")), lambda n, j: F.struct(n.alias("mask"), i.alias("paragraph"), j.alias("place")))))
    before = both.select(key, "spans", F.explode(listed(F.col("masked"))).alias("b")).select(key, "b.mask", F.col("b.paragraph").alias("paragraph"), F.get("spans", F.col("b.mask").cast("int"))["kind"].alias("kind"))
    after = both.where("_new is not null").select(key, F.explode(listed(F.col("_new"))).alias("a")).groupBy(key, F.col("a.mask").alias("mask")).agg(F.count("*").alias("times"), F.min("a.paragraph").alias("to"), F.min("a.place").alias("place"))
    told = before.join(after, [key, "mask"], "full")
    single = (F.col("times") == 1) & (F.col("paragraph") == F.col("to"))
    ranked = told.withColumn("_one", F.coalesce(single, F.lit(False)))
    of = Window.partitionBy(key, "paragraph", "_one")
    ranked = ranked.withColumns({"was": F.row_number().over(of.orderBy("mask")), "is": F.row_number().over(of.orderBy("place", "mask"))})
    verdict = (
        F.when(F.col("kind").isNull(), "foreign").when(F.coalesce("times", F.lit(0)) == 0, "lost").when(F.col("times") > 1, "doubled")
        .when(F.col("paragraph") != F.col("to"), "moved").when(F.col("was") != F.col("is"), "reordered").otherwise("kept")
    )
    return ranked.select(key, "mask", "kind", verdict.alias("verdict"))


def restored(kept: DataFrame, rewrites: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, text, refused``: the rewrite with its masks back; refused: numbers (from 0) of the paragraphs that stand as they were, -1 alone where the number of paragraphs changed and the whole text does."""
    both = kept.join(rewrites.select(key, F.coalesce(F.col(column), F.lit("")).alias("_new")), key)
    old, new = _paragraphs(F.col("masked")), _paragraphs(F.col("_new"))
    told = both.select("*", old.alias("_old"), new.alias("_fresh")).withColumn("_fits", F.size("_old") == F.size("_fresh"))
    pairs = F.zip_with("_old", F.when(F.col("_fits"), F.col("_fresh")).otherwise(F.col("_old")), lambda o, n: F.struct(o["body"].alias("o"), n["body"].alias("n"), n["gap"].alias("gap"), (_numbers(o["body"], F.col("prefix")) == _numbers(n["body"], F.col("prefix"))).alias("same")))
    told = told.select(key, "prefix", "spans", "_fits", pairs.alias("_pairs"))
    joined = F.array_join(F.transform("_pairs", lambda p: F.concat(F.when(p["same"], p["n"]).otherwise(p["o"]), p["gap"])), "")
    refused = F.when(~F.col("_fits"), F.array(F.lit(-1))).otherwise(F.filter(F.transform("_pairs", lambda p, i: F.when(~p["same"], i)), lambda i: i.isNotNull()))
    told = told.select(key, "spans", refused.alias("refused"), joined.alias("_text"), "prefix")
    values = F.concat(F.transform(_numbers(F.col("_text"), F.col("prefix")), lambda n: F.get("spans", n.cast("int"))["value"]), F.array(F.lit("")))
    back = F.array_join(F.zip_with(F.split("_text", _token(F.col("prefix")), -1), values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    return told.select(key, back.alias("text"), "refused")
