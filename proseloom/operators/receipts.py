"""Receipts of checks, their replay and audit, and hash-chained logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import rules
from proseloom.operators import check as C

SCHEMA, AUDIT_SCHEMA = "proseloom/receipt/v1", "proseloom/audit/v1"
GENESIS = "sha256:" + "0" * 64


def ruleset_version() -> str:
    """The first 16 hex digits of the SHA-256 of all rules."""
    return hashlib.sha256("\n".join(f"{r.tier}\t{r.rule_id}\t{r.pattern}" for r in rules.rules()).encode()).hexdigest()[:16]


def made(documents: DataFrame, profile: C.Profile | None = None, redact: str | None = None) -> DataFrame:
    """One receipt per document: text hash, ruleset, gate, verdict, score and the findings.

    redact: None keeps matches and offsets; "drop" keeps neither; "hash" keeps the match's SHA-256.
    """
    if redact not in (None, "drop", "hash"):
        raise ValueError(f"redact must be None, 'drop' or 'hash', not {redact!r}")
    fields = [F.col("line"), F.col("rule_id"), F.col("tier"), F.col("category")]
    fields += [F.col("start"), F.col("end"), F.col("match")] if redact is None else [F.sha2("match", 256).alias("match_sha256")] if redact == "hash" else []
    found = C.findings(documents, profile).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))
    checked = C.check(documents, profile)
    hashes = documents.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    joined = checked.join(hashes, "doc_id").join(found, "doc_id", "left")
    return joined.select("doc_id", F.lit(AUDIT_SCHEMA if redact else SCHEMA).alias("schema"), F.lit(ruleset_version()).alias("ruleset_version"), "profile", "text_sha256", "gate", "verdict", "sufficient", "texture_score", "findings", F.lit(redact).cast("string").alias("redaction"))


def verified(receipts: DataFrame, documents: DataFrame, profile: C.Profile | None = None, redact: str | None = None) -> DataFrame:
    """``doc_id, result, detail``: each receipt replayed against its document, first reason first."""
    now = made(documents, profile, redact).select("doc_id", *(F.col(c).alias(f"now_{c}") for c in ("text_sha256", "gate", "verdict", "texture_score", "findings", "ruleset_version", "schema")))
    j = receipts.join(now, "doc_id", "left")
    same = (F.col("gate") == F.col("now_gate")) & (F.col("texture_score") == F.col("now_texture_score")) & F.col("findings").eqNullSafe(F.col("now_findings"))
    reasons = [
        (F.col("now_schema").isNull(), "Unverifiable", "no such document"),
        (F.col("schema") != F.col("now_schema"), "Unverifiable", "unknown or other receipt schema"),
        (F.col("ruleset_version") != F.col("now_ruleset_version"), "Unverifiable", "ruleset changed"),
        (F.col("text_sha256") != F.col("now_text_sha256"), "Unverifiable", "text does not match the receipt's text hash"),
        (~same, "Drift", "re-derived findings or verdict differ from the receipt"),
        (F.col("now_verdict") == "unverifiable", "Unverifiable", "below the signal floor"),
    ]
    result, detail = F.lit("Match"), F.lit("re-derived")
    for when, name, why in reversed(reasons):
        result, detail = F.when(when, name).otherwise(result), F.when(when, why).otherwise(detail)
    return j.select("doc_id", result.alias("result"), detail.alias("detail"))


def audit(receipts: DataFrame, current: str) -> DataFrame:
    """``gate, verdict, receipts, stale`` over grouping sets (gate), (verdict) and all; receipts: ``gate, verdict, ruleset_version``."""
    told = receipts.select(F.coalesce("gate", F.lit("?")).alias("gate"), F.coalesce("verdict", F.lit("?")).alias("verdict"), (F.coalesce("ruleset_version", F.lit("")) != current).cast("long").alias("stale"))
    return told.groupingSets([["gate"], ["verdict"], []], "gate", "verdict").agg(F.count("*").alias("receipts"), F.sum("stale").alias("stale"))


def blocked_rules(receipts: DataFrame, top: int = 10) -> DataFrame:
    """``rule_id, times``: the rules that blocked receipts hold most often (a top-k list)."""
    each = receipts.where("gate = 'blocked'").select(F.explode("findings.rule_id").alias("rule_id"))
    return each.groupBy("rule_id").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "rule_id").limit(top)


def recent(receipts: DataFrame, now: Column, days: int) -> DataFrame:
    """Receipts whose ``created_at`` lies in the last ``days`` days before ``now``; malformed stamps never do."""
    at = F.try_to_timestamp("created_at")
    return receipts.where((at >= now - F.make_dt_interval(F.lit(days))) & (at <= now))


def entry_hash(seq: Column, kind: Column, day: Column, body: Column, prev: Column) -> Column:
    """The hash of a log entry: SHA-256 of its fields in a fixed order, tabs between."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\t", seq.cast("string"), kind, day.cast("string"), F.coalesce(body, F.lit("")), prev), 256))


def chain_problems(entries: DataFrame) -> DataFrame:
    """``log_id, seq, problem``: entries out of sequence, not linked to the one before, or changed after they were hashed.

    entries: ``log_id, seq, kind, day, body, prev, hash``. Logs are independent of each other.
    """
    order = Window.partitionBy("log_id").orderBy("seq", "hash")
    told = entries.withColumns({"expected": F.row_number().over(order).cast("long"), "before": F.coalesce(F.lag("hash").over(order), F.lit(GENESIS)), "again": entry_hash(F.col("seq"), F.col("kind"), F.col("day"), F.col("body"), F.col("prev"))})
    problems = F.array_compact(
        F.array(
            F.when(~F.col("seq").eqNullSafe(F.col("expected")), "sequence number out of order"),
            F.when(~F.col("prev").eqNullSafe(F.col("before")), "does not link to the entry before it"),
            F.when(~F.col("hash").eqNullSafe(F.col("again")), "content does not match its hash"),
        )
    )
    return told.select("log_id", "seq", F.explode(problems).alias("problem"))


def last_good(entries: DataFrame) -> DataFrame:
    """``log_id, good`` (entries before the chain first breaks), ``hash`` (of the last of them, or the genesis hash)."""
    bad = chain_problems(entries).groupBy("log_id").agg(F.min("seq").alias("bad"))
    joined = entries.join(bad, "log_id", "left").withColumn("ok", F.col("bad").isNull() | (F.col("seq") < F.col("bad")))
    agg = joined.groupBy("log_id").agg(F.count_if("ok").alias("good"), F.max_by("hash", F.when(F.col("ok"), F.col("seq"))).alias("h"))
    return agg.select("log_id", "good", F.when(F.col("good") > 0, F.col("h")).otherwise(GENESIS).alias("hash"))
