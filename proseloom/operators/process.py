"""Process records: hash-chained logs that grow by batches of events, and what they prove.

An entry holds the hash of the one before it and a hash of its own content. Faults are found by
joining each entry with its predecessor's number, so a log of any length is checked entry by
entry, not in one task. Events are appended in the order of their time and id; one that a log
already holds adds nothing, so a batch can be replayed. A writer may say on which entry an event
builds: where the log has gone on since, the event is refused as a fork. A log with a fault is
never extended; it is restarted under a new name, from its last good entry, and carries on all
assistance that it had recorded. The chain of one log is sequential by its nature: its new
events stream through one task, which holds the last hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import values
from proseloom.operators.receipts import GENESIS, entry_hash

ENTRY = "log_id string, seq long, event_id string, kind string, day string, body string, prev string, hash string"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
#: Kinds that record help; a restarted log carries them on.
ASSISTANCE = "assist"


def faults(entries: DataFrame) -> DataFrame:
    """``log_id, seq, fault`` of every fault: fork (several entries under one number), gap (no entry under the number before), number (none, or below 1), link (does not name its predecessor's hash) and content (hash of something else)."""
    told = entries.select("log_id", "seq", "prev", "hash", entry_hash(F.col("seq"), F.col("kind"), F.col("day"), F.col("body"), F.col("prev")).alias("again"))
    before = told.groupBy("log_id", (F.col("seq") + 1).alias("seq")).agg(F.min("hash").alias("before"), F.count("*").alias("n_before"))
    forks = told.groupBy("log_id", "seq").agg(F.count("*").alias("n")).where("n > 1 and seq is not null").select("log_id", "seq", F.lit("fork").alias("fault"))
    both = told.join(before, ["log_id", "seq"], "left")
    expected = F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("before"))
    numbered = F.coalesce(F.col("seq") >= 1, F.lit(False))
    alone = F.coalesce(F.col("n_before"), F.lit(1)) == 1  # behind a fork either link may be right
    found = F.array_compact(
        F.array(
            F.when(~numbered, "number"),
            F.when(numbered & (F.col("seq") > 1) & F.col("before").isNull(), "gap"),
            F.when(numbered & expected.isNotNull() & alone & ~F.col("prev").eqNullSafe(expected), "link"),
            F.when(~F.col("hash").eqNullSafe(F.col("again")), "content"),
        )
    )
    return both.select("log_id", "seq", F.explode(found).alias("fault")).unionByName(forks)


def heads(entries: DataFrame) -> DataFrame:
    """``log_id, entries`` (their number), ``head`` (the last one's hash), ``first_fault`` (the least number with a fault, null in a sound log), ``good`` and ``good_hash`` (entries before it and the last one's hash, or the genesis hash)."""
    bad = faults(entries).groupBy("log_id").agg(F.min(F.coalesce("seq", F.lit(0))).alias("first_fault"))
    joined = entries.select("log_id", "seq", "hash").join(bad, "log_id", "left")
    sound = F.col("first_fault").isNull() | (F.col("seq") < F.col("first_fault"))
    agg = joined.groupBy("log_id").agg(F.count("*").alias("entries"), F.max_by("hash", "seq").alias("head"), F.first("first_fault").alias("first_fault"), F.count_if(sound).alias("good"), F.max_by("hash", F.when(sound, F.col("seq"))).alias("_g"))
    return agg.select("log_id", "entries", "head", "first_fault", "good", F.when(F.col("good") > 0, F.col("_g")).otherwise(GENESIS).alias("good_hash"))


def _digest(seq: int, kind: str, day: str, body: str | None, prev: str) -> str:
    """``receipts.entry_hash`` of one entry."""
    return "sha256:" + hashlib.sha256("\t".join(x for x in (str(seq), kind, day, body or "", prev) if x is not None).encode()).hexdigest()


OUTCOME = f"{ENTRY}, problem string"


def appended(entries: DataFrame, events: DataFrame) -> DataFrame:
    """What becomes of each event: the entry that it makes, or its ``problem``: known (the log holds its id, or an event before it in the batch does), broken (the log has a fault) or fork (``builds_on`` isn't the log's last hash when its turn comes).

    entries: the logs so far; events: ``log_id, event_id, at, kind, day, body, builds_on`` (null:
    on whatever is there). A log without entries begins. Of a chain of events that a writer
    prepared ahead, each names the hash that the one before it will have. The outcome holds no
    row of ``entries``; write its rows without a problem beside them.
    """
    known = entries.select("log_id", "event_id").distinct().withColumn("_held", F.lit(True))
    state = heads(entries).select("log_id", "entries", "head", F.col("first_fault").isNotNull().alias("broken"))
    events = events.select("log_id", "event_id", F.col("at").cast("string").alias("at"), "kind", "day", "body", "builds_on", F.col("at").alias("_at")).where("log_id is not null")
    judged = events.join(known, ["log_id", "event_id"], "left")
    null = lambda kind: F.lit(None).cast(kind)
    rows = judged.select("log_id", F.lit(1).alias("rank"), "_at", "event_id", "kind", "day", "body", "builds_on", F.coalesce("_held", F.lit(False)).alias("held"), null("long").alias("n"), null("string").alias("head"))
    first = state.join(events.select("log_id").distinct(), "log_id").select("log_id", F.lit(0).alias("rank"), null("string").cast(events.schema["_at"].dataType).alias("_at"), null("string").alias("event_id"), null("string").alias("kind"), null("string").alias("day"), null("string").alias("body"), null("string").alias("builds_on"), F.col("broken").alias("held"), F.col("entries").alias("n"), "head")
    ordered = first.unionByName(rows).repartition("log_id").sortWithinPartitions("log_id", "rank", "_at", "event_id", "kind", "body").drop("_at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, seq, prev, broken, last = None, 0, GENESIS, False, None
        for batch in batches:
            out = []
            for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if r.log_id != log:
                    log, seq, prev, broken, last = r.log_id, 0, GENESIS, False, None
                if r.rank == 0:
                    seq, prev, broken = int(r.n), r.head, bool(r.held)
                    continue
                problem = "known" if r.held or (r.event_id is not None and r.event_id == last) else "broken" if broken else "fork" if r.builds_on is not None and r.builds_on != prev else None
                if problem:
                    out.append((log, None, r.event_id, r.kind, r.day, r.body, None, None, problem))
                    continue
                seq, before, last = seq + 1, prev, r.event_id
                prev = _digest(seq, r.kind, r.day, r.body, before)
                out.append((log, seq, r.event_id, r.kind, r.day, r.body, before, prev, None))
            yield pd.DataFrame(out, columns=[*COLUMNS, "problem"]).astype({"seq": "Int64"})

    return ordered.mapInPandas(run, OUTCOME)


def restarted(entries: DataFrame, reason: Column, day: Column) -> DataFrame:
    """Entries of a new log, named ``<log>+``, for each log with a fault: a continuation that names the last good hash and the reason, then all assistance that the old log holds, in its order. A sound log gives none."""
    broken = heads(entries).where("first_fault is not null")
    body = F.to_json(F.struct(F.col("good_hash").alias("continues"), F.col("good").alias("good"), reason.alias("reason")))
    opening = broken.select(F.concat("log_id", F.lit("+")).alias("log_id"), F.lit("continuation").alias("event_id"), F.lit(0).cast("long").alias("at"), F.lit("continuation").alias("kind"), day.cast("string").alias("day"), body.alias("body"))
    helped = entries.where(F.col("kind") == ASSISTANCE).join(broken.select("log_id"), "log_id", "left_semi")
    carried = helped.select(F.concat("log_id", F.lit("+")).alias("log_id"), F.concat(F.lit("carried:"), "event_id").alias("event_id"), F.coalesce(F.greatest("seq", F.lit(1)), F.lit(1)).cast("long").alias("at"), "kind", "day", "body")
    events = opening.unionByName(carried).withColumn("builds_on", F.lit(None).cast("string"))
    return appended(entries.limit(0), events).where("problem is null").select(*COLUMNS)


def revealed(entries: DataFrame, reveals: DataFrame) -> DataFrame:
    """``log_id, seq, verdict`` of reveals (``log_id, seq, salt`` as hex, ``text``): verified, or why not: no entry, no commitment (the entry's body holds none), other text, broken (the entry stands behind a fault)."""
    state = heads(entries).select("log_id", "first_fault")
    named = entries.select("log_id", "seq", F.get_json_object("body", "$.commitment").alias("told"), F.lit(True).alias("there")).join(state, "log_id", "left")
    both = reveals.select("log_id", "seq", "salt", "text").join(named, ["log_id", "seq"], "left")
    verdict = (
        F.when(F.col("there").isNull(), "no entry").when(F.col("first_fault").isNotNull() & (F.col("seq") >= F.col("first_fault")), "broken").when(F.col("told").isNull(), "no commitment")
        .when(F.col("told").eqNullSafe(values.commitment(F.col("salt"), F.col("text"))), "verified").otherwise("other text")
    )
    return both.select("log_id", "seq", verdict.alias("verdict"))


def exported(entries: DataFrame) -> DataFrame:
    """``log_id, refused, entries, days, first_day, last_day, drafts, assists, statement``: a disclosure of each log, or why it is refused (a fault, or nothing recorded but its beginning)."""
    kinds = entries.groupBy("log_id").agg(
        F.count("*").alias("entries"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_if(F.col("kind") == "draft").alias("drafts"), F.count_if(F.col("kind") == ASSISTANCE).alias("assists"), F.count_if(~F.col("kind").isin("init", "continuation")).alias("work"),
    )
    both = kinds.join(heads(entries).select("log_id", "first_fault"), "log_id")
    refused = F.when(F.col("first_fault").isNotNull(), F.concat(F.lit("fault at entry "), F.col("first_fault").cast("string"))).when(F.col("work") == 0, "nothing recorded")
    help_ = F.when(F.col("assists") == 0, "no assistance was recorded").otherwise(F.concat(F.lit("assistance was recorded "), F.col("assists").cast("string"), F.lit(" times")))
    said = F.concat(F.lit("Worked on over "), F.col("days").cast("string"), F.lit(" days, "), "first_day", F.lit(" to "), "last_day", F.lit(": "), F.col("drafts").cast("string"), F.lit(" drafts; "), help_, F.lit("."))
    return both.select("log_id", refused.alias("refused"), "entries", "days", "first_day", "last_day", "drafts", "assists", F.when(refused.isNull(), said).alias("statement"))
