"""Rhetorical devices: readers over sentences, each a row of ``doc_id, line, device, detail, sentence``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import rules, text
from proseloom.operators import lines as L


def _order():
    return Window.partitionBy("doc_id").orderBy("line", "n")


def _sentences(documents: DataFrame) -> DataFrame:
    rows = L.sentence_rows(L.prose(documents))
    return rows.withColumn("w", F.transform(text.words(F.col("sentence")), lambda w: F.lower(w)))


def read(documents: DataFrame) -> DataFrame:
    """All devices found, in one pass over the sentences: anaphora, epistrophe, anadiplosis, epizeuxis, polysyndeton, asyndeton, tricolon, alliteration, isocolon."""
    return _found(_sentences(documents)).select("doc_id", "line", "d.device", "d.detail", "sentence")


def _found(s: DataFrame, *more: str) -> DataFrame:
    """``doc_id, line, sentence, d`` (``struct<device, detail>``) and further columns of the sentences."""
    w, sentence = F.col("w"), F.col("sentence")
    sounds = F.transform(F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*rules.NGRAM_STOP)), lambda x: F.substring(x, 1, 1))
    s = s.withColumns({"first": F.element_at(w, 1), "last": F.element_at(w, -1), "pairs": text.grams(w, 2), "ands": F.size(F.filter(w, lambda x: x.isin("and", "or", "nor"))), "sounds": sounds})
    s = s.withColumns({f"last_{c}": F.lag(c).over(_order()) for c in ("w", "words", "first", "last")})
    s = s.withColumn("doubled", F.filter("pairs", lambda g: (F.element_at(g, 1) == F.element_at(g, 2)) & (F.length(F.element_at(g, 1)) >= 3)))
    content = lambda x: ~F.col(x).isin(*rules.OPENER_STOP) & (F.length(x) >= 3)
    same = lambda a, b: F.col(a) == F.col(b)
    alike = F.exists(text.grams(F.col("sounds"), 3), lambda g: (F.size(F.array_distinct(g)) == 1) & F.element_at(g, 1).rlike("[b-df-hj-np-tv-z]"))
    triple = r"(?U)\b\w+,\s+\w+,?\s+and\s+\w+\b"
    says = lambda name, when, detail: F.when(when, F.struct(F.lit(name).alias("device"), detail.cast("string").alias("detail")))
    found = F.array(
        says("anaphora", same("first", "last_first") & content("first"), F.col("first")),
        says("epistrophe", same("last", "last_last") & content("last"), F.col("last")),
        says("anadiplosis", same("first", "last_last") & content("first"), F.col("first")),
        says("epizeuxis", F.size("doubled") > 0, F.element_at(F.try_element_at("doubled", F.lit(1)), 1)),
        says("polysyndeton", (F.col("ands") >= 3) & ~sentence.contains(","), F.col("ands")),
        says("asyndeton", (F.col("ands") == 0) & sentence.rlike(r"(?U)\b\w+,\s\w+,\s\w+[.!?]?$"), F.lit("list without a conjunction")),
        says("tricolon", sentence.rlike(triple), F.regexp_extract(sentence, triple, 0)),
        says("alliteration", alike, F.lit("three content words begin alike")),
        says("isocolon", same("words", "last_words") & (F.col("words") >= 4) & (F.size(F.array_intersect("w", "last_w")) >= 2), F.col("words")),
    )
    return s.select("doc_id", "line", "sentence", *more, F.explode(F.array_compact(found)).alias("d"))


def rates(documents: DataFrame) -> DataFrame:
    """``doc_id, device, hits, per_100``: hits for 100 sentences."""
    s = _sentences(documents).withColumn("sentences", F.count("*").over(Window.partitionBy("doc_id")))  # counted where they are read
    counted = _found(s, "sentences").groupBy("doc_id", "d.device", "sentences").agg(F.count("*").alias("hits"))
    return counted.select("doc_id", "device", "hits", (F.col("hits") * 100.0 / F.col("sentences")).alias("per_100"))


def opener_runs(documents: DataFrame, least: int = 2) -> DataFrame:
    """``doc_id, opener, line, run, tier``: maximal runs of sentences with one opener; an article counts with the word after it.

    tier: HIGH for three or more, MEDIUM where that opener is a pronoun, LOW for a pair.
    """
    s = _sentences(documents)
    article = F.element_at("w", 1).isin("the", "a", "an")
    opener = F.when(article & (F.size("w") > 1), F.concat_ws(" ", F.element_at("w", 1), F.element_at("w", 2))).otherwise(F.element_at("w", 1))
    told = s.withColumn("opener", opener)
    new = F.coalesce((F.col("opener") != F.lag("opener").over(_order())).cast("int"), F.lit(1))
    islands = told.withColumn("new", new).withColumn("island", F.sum("new").over(_order()))
    agg = islands.groupBy("doc_id", "island", "opener").agg(F.count("*").alias("run"), F.min("line").alias("line")).where(F.col("run") >= least)
    tier = F.when(F.col("run") < 3, "LOW").when(F.col("opener").isin(*rules.PRONOUNS) & (F.col("run") == 3), "MEDIUM").otherwise("HIGH")
    return agg.select("doc_id", "opener", "line", "run", tier.alias("tier"))


#: Endings that a word may lose for its base form, and what takes their place; letters that must stay.
ENDINGS = (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("d", ""), ("ly", ""))
STEM = 3
#: Words from the first to the last of a crossed figure at most.
REACH = 12


def lemma(word: Column) -> Column:
    """One base form of a word in lower case, so that "owes" and "owe" are equal: the shortest of the word and its stripped forms, the first by spelling of equally short ones."""
    forms = [F.struct(F.length(word).alias("n"), word.alias("form"))]
    for end, by in ENDINGS:
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(by))
        forms.append(F.when(word.endswith(end) & (F.length(word) - len(end) >= STEM), F.struct(F.length(cut).alias("n"), cut.alias("form"))))
    return F.array_min(F.array(*forms))["form"]


def crossed(lemmas: Column, reach: int = REACH) -> Column:
    """Crossed figures of a sequence: ``struct<a, b, c, d>`` of places (from 0) where the outer two are one word and the inner two another, a + reach > d, the narrowest for each a; nulls are no words.

    Equal words are paired within the reach first, each with those after it, so the work is
    linear in the sequence, by the square of the reach.
    """
    near = lambda seq: F.transform(seq, lambda x, i: F.filter(F.transform(F.slice(seq, i + 2, F.lit(reach - 1)), lambda y, k: F.when(y == x, i + 1 + k)), lambda j: j.isNotNull()))

    def figures(seq: Column) -> Column:
        return text.let(near(seq), lambda later: F.filter(F.transform(seq, lambda x, a: first(seq, later, x, a)), lambda f: f.isNotNull()))

    def first(seq: Column, later: Column, x: Column, a: Column) -> Column:
        inner = lambda d: F.flatten(F.transform(F.sequence(a + 1, F.greatest(d - 2, a + 1)), lambda b: F.transform(F.filter(F.coalesce(F.get(later, b), F.array().cast("array<int>")), lambda c: (c < d) & (F.get(seq, b) != x)), lambda c: F.struct(d.alias("d"), b.alias("b"), c.alias("c")))))
        best = F.array_min(F.flatten(F.transform(F.filter(F.get(later, a), lambda d: d - a >= 3), inner)))
        return F.when(x.isNotNull() & best.isNotNull(), F.struct(a.alias("a"), best["b"].alias("b"), best["c"].alias("c"), best["d"].alias("d")))

    return text.let(lemmas, figures)


def chiasmus(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, line, n, outer, inner, sentence``: sentences that turn two words around ("eat to live, not live to eat"), by base forms; words of under three letters and function words don't count."""
    s = _sentences(documents)
    plain = F.transform("w", lambda x: F.when((F.length(x) >= 3) & ~x.isin(*rules.NGRAM_STOP), lemma(x)))
    found = s.select("doc_id", "line", "n", "sentence", F.explode(F.array(plain)).alias("l")).select("doc_id", "line", "n", "sentence", "l", F.explode(crossed(F.col("l"), reach)).alias("f"))
    return found.select("doc_id", "line", "n", F.get("l", F.col("f.a")).alias("outer"), F.get("l", F.col("f.b")).alias("inner"), "sentence")
