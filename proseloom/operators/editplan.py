"""Edits in two steps, and what they changed: a plan that binds a text, its settings and its findings, a submission that is checked against it, and a report sentence by sentence.

A plan's id is a signed statement of what it was made for; a submission whose text, settings or
rules are no longer those is stale, one that isn't signed is forged. An accepted rewrite keeps
the facts of each paragraph (others stand as they were) and has no more blocking findings than
the text it replaces. In the report both versions are aligned by their sentences, in order, and
every finding of either side belongs to one record, the last that begins before it.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.functions import text, values
from proseloom.operators import check as C
from proseloom.operators import compare
from proseloom.operators.receipts import ruleset_version
from proseloom.sources.tables import written

PARAGRAPH = r"\n[ \t]*\n(?:[ \t]*\n)*"
SENTENCE_END = r"[.!?][\"'”’)\]]*\s+"


def _settings(profile: C.Profile, goal: str, freeze: tuple[str, ...], allow: tuple[str, ...]) -> str:
    import json

    told = {"allow": sorted(allow), "freeze": sorted(freeze), "goal": goal, "keep": sorted(profile.keep), "options": profile.options, "packs": sorted(profile.packs), "profile": profile.name, "promote": sorted(profile.promote), "slop": profile.slop, "suppress": sorted(profile.suppress)}
    return json.dumps(told, sort_keys=True, separators=(",", ":"))


def _findings(documents: DataFrame, profile: C.Profile) -> DataFrame:
    """``doc_id, findings`` (sorted) of every document, and their digest."""
    found = C.findings(documents, profile).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rule_id", "tier", "category", "match"))).alias("findings"))
    every = documents.select("doc_id").join(found, "doc_id", "left")
    kind = found.schema["findings"].dataType
    return every.select("doc_id", F.coalesce("findings", F.array().cast(kind)).alias("findings"))


def plans(documents: DataFrame, secret: str, profile: C.Profile | None = None, goal: str = "fix", freeze: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, plan_id, gate, findings`` of each document: what an editor is to mend, and the id with which to submit a rewrite. goal: fix or polish (whose result must pass the gate)."""
    p = profile or C.Profile()
    told = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")).join(_findings(documents, p), "doc_id").join(C.check(documents, p).select("doc_id", "gate"), "doc_id")
    payload = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc"), F.col("_sha").alias("text"), F.lit(_settings(p, goal, freeze, allow)).alias("settings"), F.lit(ruleset_version()).alias("rules"), F.sha2(F.to_json("findings"), 256).alias("findings")))
    return told.select("doc_id", values.token(payload, F.lit(secret)).alias("plan_id"), "gate", "findings")


def _payload(plan_id: Column) -> Column:
    """What a plan's id states: the part before its signature, from URL-safe base64."""
    return F.decode(F.try_to_binary(F.translate(F.substring_index(plan_id, ".", 1), "-_", "+/"), F.lit("base64")), "UTF-8")


def submitted(documents: DataFrame, submissions: DataFrame, secret: str, profile: C.Profile | None = None, goal: str = "fix", freeze: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, status, reason, text, gate_before, gate_after, refused`` (paragraphs) of each submission (``doc_id, plan_id, rewrite``).

    status: accepted; unchanged (nothing was left to accept); stale (the text, the settings or
    the rules differ from the plan's), forged (no plan of this secret) or refused (more blocking
    findings than before or, to polish, a blocked result), in which the text stands as it is.
    """
    p = profile or C.Profile()
    both = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("original")).join(submissions.select("doc_id", "plan_id", F.coalesce("rewrite", F.lit("")).alias("rewrite")), "doc_id")
    payload = _payload(F.col("plan_id"))
    stated = F.from_json(payload, "doc string, text string, settings string, rules string, findings string")
    told = both.select("*", payload.alias("_payload"), stated.alias("_s"))
    signed = F.coalesce(F.col("plan_id") == values.token(F.col("_payload"), F.lit(secret)), F.lit(False)) & (F.col("_s.doc") == F.col("doc_id").cast("string"))
    why = (
        F.when(~F.coalesce(signed, F.lit(False)), "forged").when(F.col("_s.text") != F.sha2("original", 256), "stale: text")
        .when(F.col("_s.settings") != _settings(p, goal, freeze, allow), "stale: settings").when(F.col("_s.rules") != ruleset_version(), "stale: rules")
    )
    judged = written(told.select("doc_id", "original", "rewrite", why.alias("why")), "submissions")
    none = lambda kind: F.lit(None).cast(kind)
    late = judged.where("why is not null").select("doc_id", F.substring_index("why", ":", 1).alias("status"), F.when(F.col("why").contains(":"), F.trim(F.substring_index("why", ":", -1))).alias("reason"), F.col("original").alias("text"), none("string").alias("gate_before"), none("string").alias("gate_after"), F.array().cast("array<bigint>").alias("refused"))
    fresh = judged.where("why is null")
    if fresh.isEmpty():
        return late
    guarded = compare.guarded(fresh.select("doc_id", "original", "rewrite"), list(freeze) or None)
    parts = guarded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("refused"), F.col("paragraph")))).alias("refused"))
    gaps = F.concat(text.matches(F.col("original"), r"\n\s*\n"), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.col("x.text"), gaps, lambda t, g: F.concat(t, g)), "")
    candidates = written(fresh.join(parts, "doc_id").select("doc_id", "original", joined.alias("candidate"), "refused"), "candidates")
    gate = lambda column, name: C.check(candidates.select("doc_id", F.col(column).alias("text")), p).select("doc_id", F.col("gate").alias(f"gate_{name}"), F.col("blocking").alias(f"n_{name}"))
    weighed = candidates.join(gate("original", "before"), "doc_id").join(gate("candidate", "after"), "doc_id")
    regressed = F.when(F.col("n_after") > F.col("n_before"), "more blocking findings than before").when(F.lit(goal == "polish") & (F.col("candidate") != F.col("original")) & (F.col("gate_after") != "ok"), "the result does not pass the gate")
    done = weighed.select("doc_id", F.when(regressed.isNotNull(), "refused").when(F.col("candidate") == F.col("original"), "unchanged").otherwise("accepted").alias("status"), regressed.alias("reason"), F.when(regressed.isNull(), F.col("candidate")).otherwise(F.col("original")).alias("text"), "gate_before", F.when(regressed.isNull(), F.col("gate_after")).otherwise(F.col("gate_before")).alias("gate_after"), "refused")
    return done.unionByName(late)


_OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2"))]))


@F.pandas_udf(_OPS)
def _aligned(before: pd.Series, after: pd.Series) -> pd.Series:
    """How one list of sentences becomes the other, in order: runs kept, replaced, deleted and inserted."""
    ops = lambda a, b: [dict(zip(("op", "i1", "i2", "j1", "j2"), o, strict=True)) for o in SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes()]
    return pd.Series([ops(a, b) for a, b in zip(before, after, strict=True)])


def paragraphs(body: Column) -> Column:
    """Paragraphs as an array of ``struct<start, body>``."""
    parts = text.cut(body, PARAGRAPH)
    placed = lambda x: F.zip_with(x, text.starts(F.transform(x, F.length)), lambda p, at: F.struct(at.alias("start"), p.alias("body")))
    return F.filter(text.let(parts, placed), lambda p, i: i % 2 == 0)


def cut(column: str, name: str, only: Callable[[Column], Column] = lambda p: F.lit(True)) -> Column:
    """Paragraphs with their sentences: ``struct<start, sentences: array<struct<start, end, flat>>>``. only: a test of paragraphs; those that fail are left out."""
    body = F.coalesce(F.col(column), F.lit(""))

    def sentences(paragraph: Column, base: Column) -> Column:
        ends = text.all_matches(paragraph, SENTENCE_END)
        cuts = F.concat(F.transform(ends, lambda e: e["end"]), F.array(F.length(paragraph).cast("long")))
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(ends, lambda e: e["end"]))
        pieces = F.zip_with(starts, cuts, lambda s, e: F.struct((base + s).alias("start"), (base + e).alias("end"), F.trim(F.regexp_replace(F.substring(paragraph, (s + 1).cast("int"), (e - s).cast("int")), r"(?U)\s+", " ")).alias("flat")))
        return F.filter(pieces, lambda p: p["flat"] != "")

    return F.transform(F.filter(paragraphs(body), lambda p: only(p["body"])), lambda p: F.struct(p["start"].alias("start"), sentences(p["body"], p["start"]).alias("sentences"))).alias(name)


def records(pairs: DataFrame) -> DataFrame:
    """``doc_id, record, paragraph, op`` (equal, replace, delete, insert), ``before, after`` and their places ``b_start, b_end, a_start, a_end`` (null on a side without sentences). pairs: ``doc_id, original, rewrite``.

    Paragraphs are paired by place; where their numbers differ, both texts are read as one paragraph.
    """
    one = pairs.select("doc_id", "original", "rewrite", cut("original", "_b"), cut("rewrite", "_a"))
    whole = lambda c: F.array(F.struct(F.lit(0).cast("long").alias("start"), F.flatten(F.transform(c, lambda p: p["sentences"])).alias("sentences")))
    same = F.size("_b") == F.size("_a")
    paired = F.arrays_zip(F.when(same, F.col("_b")).otherwise(whole("_b")).alias("b"), F.when(same, F.col("_a")).otherwise(whole("_a")).alias("a"))
    rows = one.select("doc_id", "original", "rewrite", F.posexplode(paired).alias("paragraph", "p"))
    rows = rows.select("doc_id", "original", "rewrite", "paragraph", F.col("p.b.sentences").alias("b"), F.col("p.a.sentences").alias("a"))
    ops = rows.withColumn("ops", _aligned(F.col("b.flat"), F.col("a.flat")))
    each = ops.select("doc_id", "original", "rewrite", "paragraph", "b", "a", F.posexplode("ops").alias("n", "o"))
    side = lambda s, lo, hi, f: F.when(F.col(hi) > F.col(lo), F.get(s, F.col(lo))["start"] if f == "start" else F.get(s, F.col(hi) - 1)["end"])
    placed = each.select("doc_id", "original", "rewrite", (F.col("paragraph") * 1_000_000 + F.col("n")).cast("long").alias("record"), F.col("paragraph").cast("long").alias("paragraph"), F.col("o.op").alias("op"), side("b", "o.i1", "o.i2", "start").alias("b_start"), side("b", "o.i1", "o.i2", "end").alias("b_end"), side("a", "o.j1", "o.j2", "start").alias("a_start"), side("a", "o.j1", "o.j2", "end").alias("a_end"))
    said = lambda body, s, e: F.coalesce(F.regexp_replace(F.substring(body, (F.col(s) + 1).cast("int"), (F.col(e) - F.col(s)).cast("int")), r"(?U)\s+$", ""), F.lit(""))
    return placed.select("doc_id", "record", "paragraph", "op", said("original", "b_start", "b_end").alias("before"), said("rewrite", "a_start", "a_end").alias("after"), "b_start", "b_end", "a_start", "a_end")


def tally(pairs: DataFrame, profile: C.Profile | None = None) -> DataFrame:
    """``doc_id, record, rule_id, gone, remaining, added``: findings by record of ``records`` and rule, record -1 for those that begin in no sentence. Over all records gone and remaining are the findings before, remaining and added those after.

    Records of one side lie apart, so a finding belongs to the last that begins at or before it, if to any. Both sides meet
    by document in one exchange, and nothing is broadcast.
    """
    p = profile or C.Profile()
    none = lambda kind: F.lit(None).cast(kind)
    span = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_start").alias("at"), F.col(f"{s}_end").alias("end"))
    spans = records(pairs).select("doc_id", "record", F.explode(F.array(span("b"), span("a"))).alias("s"))
    held = spans.where("s.at is not null and doc_id is not null").select("doc_id", "s.side", "s.at", F.struct("s.end", "record").alias("held"), none("string").alias("rule_id"))
    for side, column in (("b", "original"), ("a", "rewrite")):
        found = C.findings(pairs.select("doc_id", F.col(column).alias("text")), p)
        held = held.unionByName(found.select("doc_id", F.lit(side).alias("side"), F.col("start").alias("at"), none(held.schema["held"].dataType).alias("held"), "rule_id"))
    before = Window.partitionBy("doc_id", "side").orderBy("at", F.col("rule_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = held.repartition("doc_id").withColumn("held", F.last("held", True).over(before)).where("rule_id is not null")
    record = F.when(F.col("at") < F.col("held.end"), F.col("held.record")).otherwise(-1)
    both = placed.groupBy("doc_id", record.alias("record"), "rule_id").agg(*(F.count_if(F.col("side") == s).alias(f"n{s}") for s in "ba"))
    remaining = F.least("nb", "na")
    return both.select("doc_id", "record", "rule_id", (F.col("nb") - remaining).alias("gone"), remaining.alias("remaining"), (F.col("na") - remaining).alias("added"))


def changes(pairs: DataFrame, profile: C.Profile | None = None) -> DataFrame:
    """``doc_id, paragraph, op, before, after, gone, remaining, added`` (arrays of ``rule_id, n``) of every record in which the sentences differ."""
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col(name) > 0, F.struct("rule_id", F.col(name).alias("n"))))).alias(name)
    counted = tally(pairs, profile).groupBy("doc_id", "record").agg(of("gone"), of("remaining"), of("added"))
    found = records(pairs).where("op != 'equal'").join(counted, ["doc_id", "record"], "left")
    none = F.array().cast(counted.schema["gone"].dataType)
    return found.select("doc_id", "record", "paragraph", "op", "before", "after", *(F.coalesce(c, none).alias(c) for c in ("gone", "remaining", "added")))
