"""Rewrite checks: which facts of an original a rewrite kept, changed, dropped or added.

Facts ("invariants") are found by kind in a fixed order; each kind reads a text in which the
spans of the kinds before it are blanked. The two sides are matched as multisets: the n-th
occurrence of a key with the n-th of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import quantities, text

# Kinds in order, with their patterns, which look at a first letter before anything else; those whose items can be told apart may be "changed".
KINDS = (
    ("code", r"(?s)```.*?(?:```|\z)|``[^\n]+?``|`[^`\n]+`"),
    ("math", r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)"),
    ("url", r"\bhttps?://[^\s<>\"'\])]+|\bwww\.[^\s<>\"'\])]+|\b[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}\b"),
    ("citation", r"\[-?@[^\]\n]{1,200}\]|\[\^[\w-]{1,40}\]|\[\d{1,4}(?:\s{0,2}[,–-]\s{0,2}\d{1,4}){0,20}\]|\([A-Z][\w'-]{1,40}(?:\s{1,3}et\s{1,3}al\.)?,?\s{1,3}(?:1[6-9]|20)\d{2}[a-z]?\)"),
    ("quote", "\"[^\"\\n]{1,2000}\"|“[^”\\n]{1,2000}”"),
    ("number", quantities.PATTERN),
    ("modal", r"(?i)(?=[mscrohn])\b(?:must|shall|should|may|might|can|could|required|recommended|optional|ought to|ha(?:ve|s|d) to|needs? to)\b"),
    ("scope", r"(?i)(?=[oseuanm])\b(?:only|solely|exclusively|unless|except|at least|at most|up to|all|every|each|none|most|some|always)\b"),
    ("negation", r"(?iU)(?=[ncw])(?:\b(?:not|never|no|none|nor|neither|cannot|without)\b|n['’]t\b)"),
    ("entity", r"(?U)(?=[A-Z])(?:(?<=[\p{L}\p{N},;)]\s)[A-Z][\w'’-]*|\b[A-Z]{2,}[\w-]*)"),
)
#: Of some kinds, literals one of which an item holds.
NEEDS = {"code": ("`",), "math": ("$$", "\\[", "\\("), "url": ("http", "www.", "@"), "citation": ("[", "("), "quote": ('"', "“")}
UNPAIRED = ("negation",)
MODAL_CLASS = {"required": "must shall required have has had need needs", "recommended": "should recommended ought", "optional": "may might can could optional"}


def _key(kind: str, value: Column) -> Column:
    low = F.lower(F.regexp_replace(value, r"\s+", " "))
    if kind == "number":
        return quantities.key(value)
    if kind == "modal":
        head = F.substring_index(low, " ", 1)
        out = F.lit("optional")
        for name, heads in MODAL_CLASS.items():
            out = F.when(head.isin(*heads.split()), name).otherwise(out)
        return F.when(value.rlike("^[A-Z]{3,}$"), F.concat(out, F.lit(":BCP14"))).otherwise(out)
    if kind == "negation":
        return F.lit("negation")
    if kind == "scope":
        return low
    if kind == "entity":
        return F.regexp_replace(value, "['’]s$", "")
    return value


def invariants(documents: DataFrame, column: str = "text", freeze: list[str] | None = None) -> DataFrame:
    """``doc_id, kind, key, value, start, end`` of every fact; freeze: further terms that must stay as they are."""
    import re

    kinds = list(KINDS)
    if freeze:
        terms = "|".join(re.escape(t.strip()) for t in sorted(freeze, key=len, reverse=True) if t.strip())
        kinds.insert(5, ("freeze", rf"(?U)(?<!\w)(?:{terms})(?!\w)"))
    state = documents.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("t0"))
    for k, (kind, pattern) in enumerate(kinds):  # projections of their own for each kind, so that no expression is nested in the next
        state = state.withColumn("cut", text.cut(F.col(f"t{k}"), pattern, NEEDS.get(kind, ()))).withColumns({f"f{k}": text.located(F.col("cut")), f"t{k + 1}": text.blank(F.col("cut"))})
    found = F.concat(*(F.transform(f"f{k}", _labelled(kind)) for k, (kind, _) in enumerate(kinds)))
    rows = state.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")
    key = F.col("value")
    for kind, _ in kinds:
        key = F.when(F.col("kind") == kind, _key(kind, F.col("value"))).otherwise(key)
    return rows.select("doc_id", "kind", key.alias("key"), "value", "start", "end")


def _labelled(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"))


def compare(pairs: DataFrame, freeze: list[str] | None = None) -> DataFrame:
    """``doc_id, kind, status, before, after, before_start, after_start``. pairs: ``doc_id, original, rewrite``.

    status: kept (one key on both sides), changed (what is left over of one kind on both sides,
    in text order), dropped, added. Negations are counted, never "changed".
    """
    side = lambda k, column: F.struct(F.lit(k).alias("side"), F.col(column).alias("text"))
    both = pairs.select("doc_id", F.explode(F.array(side(0, "original"), side(1, "rewrite"))).alias("x")).select(F.struct("doc_id", "x.side").alias("doc_id"), "x.text")
    facts = invariants(both, "text", freeze).select("doc_id.doc_id", "doc_id.side", "kind", "key", "value", "start").repartition("doc_id")  # the one exchange of all steps
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind", "key", "side").orderBy("start"))
    of = lambda column, k: F.max(F.when(F.col("side") == k, F.col(column)))
    columns = {"before": of("value", 0), "after": of("value", 1), "before_start": of("start", 0), "after_start": of("start", 1)}
    met = facts.withColumn("nth", nth).groupBy("doc_id", "kind", "key", "nth").agg(*(c.alias(n) for n, c in columns.items()))
    left = F.when(F.col("after").isNull(), "dropped").when(F.col("before").isNull(), "added").otherwise("kept")
    met = met.withColumn("left", left)
    at = F.row_number().over(Window.partitionBy("doc_id", "kind", "left").orderBy(F.coalesce("before_start", "after_start")))
    apart = F.col("kind").isin(*UNPAIRED) & (F.col("left") == "dropped")
    met = met.withColumn("at", at).withColumns({"at": F.when(apart, -F.col("at")).otherwise(F.col("at")), "kept": F.col("left") == "kept"})
    told = met.groupBy("doc_id", "kind", "kept", "at").agg(*(F.max(n).alias(n) for n in columns))
    status = F.when(F.col("after").isNull(), "dropped").when(F.col("before").isNull(), "added").when(F.col("kept"), "kept").otherwise("changed")
    return told.select("doc_id", "kind", status.alias("status"), *columns)


def verdicts(pairs: DataFrame, allow: list[str] | None = None, freeze: list[str] | None = None) -> DataFrame:
    """Per pair: counts by status and whether the rewrite is ``preserved``; allow: kinds that may change."""
    rows = compare(pairs, freeze)
    counts = rows.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("kept", "changed", "dropped", "added")), F.count_if((F.col("status") != "kept") & ~F.col("kind").isin(*(allow or [""]))).alias("blocking"))
    whole = pairs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    return whole.withColumn("preserved", F.col("blocking") == 0)


def guarded(pairs: DataFrame, freeze: list[str] | None = None) -> DataFrame:
    """``doc_id, paragraph, text, refused``: the rewrite by paragraph, with the original's wherever a fact was not kept.

    Paragraphs are matched by place; a rewrite with another number of paragraphs is refused whole.
    """
    split = pairs.select("doc_id", F.split(F.coalesce("original", F.lit("")), r"\n\s*\n", -1).alias("o"), F.split(F.coalesce("rewrite", F.lit("")), r"\n\s*\n", -1).alias("w"))
    same = split.withColumn("fits", F.size("o") == F.size("w"))
    rows = same.select("doc_id", "fits", F.posexplode(F.arrays_zip("o", F.when(F.col("fits"), F.col("w")).otherwise(F.col("o")).alias("w"))).alias("p", "x"))
    each = rows.select(F.struct("doc_id", "p").alias("doc_id"), "fits", F.col("x.o").alias("original"), F.col("x.w").alias("rewrite"))
    judged = each.join(verdicts(each, freeze=freeze).select("doc_id", "preserved"), "doc_id")
    ok = F.col("preserved") & F.col("fits")
    return judged.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.p").cast("long").alias("paragraph"), F.when(ok, F.col("rewrite")).otherwise(F.col("original")).alias("text"), (~ok).alias("refused"))


def rule_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rule_id, before, after, delta``: findings by rule on both sides of an edit."""
    count = lambda f, name: f.groupBy("rule_id").agg(F.count("*").alias(name))
    joined = count(before, "before").join(count(after, "after"), "rule_id", "full").na.fill(0)
    return joined.withColumn("delta", F.col("after") - F.col("before"))
