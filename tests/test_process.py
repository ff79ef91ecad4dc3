"""Process records: chains by a plain loop, replays, forks, gaps, restarts, reveals, and the stream of batches."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from proseloom.functions import values
from proseloom.operators import process
from proseloom.operators.receipts import GENESIS
from proseloom.streaming import process_log

EVENT = "log_id string, event_id string, at long, kind string, day string, body string, builds_on string"


def digest(seq, kind, day, body, prev):
    return "sha256:" + hashlib.sha256("\t".join([str(seq), kind, day, body or "", prev]).encode()).hexdigest()


def chain(events):
    logs = {}
    for log, event, _, kind, day, body, _ in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        entries = logs.setdefault(log, [])
        prev = entries[-1][-1] if entries else GENESIS
        entries.append((log, len(entries) + 1, event, kind, day, body, prev, digest(len(entries) + 1, kind, day, body, prev)))
    return sorted(e for entries in logs.values() for e in entries)


def some(seed, n=120, logs="abc"):
    rng = random.Random(seed)
    return [(rng.choice(logs), f"e{k}", rng.randrange(50), rng.choice(["draft", "note", "assist"]), f"2026-01-{rng.randint(10, 28)}", rng.choice([None, "", "wörter", "{}"]), None) for k in range(n)]


def rows(frame):
    return sorted(tuple(r[c] for c in process.COLUMNS) for r in frame.collect())


def test_chains_equal_a_plain_loop_and_a_replay_adds_nothing(spark):
    first, more = some(1), [(*e[:1], "f" + e[1], e[2] + 100, *e[3:]) for e in some(2, 60, "abcd")]
    empty = spark.createDataFrame([], process.ENTRY)
    one = process.appended(empty, spark.createDataFrame(first, EVENT).repartition(4)).cache()
    assert one.where("problem is not null").count() == 0 and rows(one) == chain(first)
    entries = one.select(*process.COLUMNS)
    again = process.appended(entries, spark.createDataFrame(first + more + more[:5], EVENT))
    told = again.groupBy("problem").count().collect()
    assert {r.problem: r["count"] for r in told} == {None: 60, "known": len(first) + 5}
    whole = entries.unionByName(again.where("problem is null").select(*process.COLUMNS)).cache()
    assert rows(whole) == chain(first + more) and process.faults(whole).collect() == []
    assert {r.log_id: (r.entries, r.first_fault) for r in process.heads(whole).collect()} == {k: (sum(e[0] == k for e in first + more), None) for k in "abcd"}
    assert process.appended(empty, spark.createDataFrame([], EVENT)).collect() == []


def test_a_writer_that_builds_on_another_entry_is_refused(spark):
    entries = chain(some(3, 6, "a"))
    log, head = spark.createDataFrame(entries, process.ENTRY), entries[-1][-1]
    ahead = digest(7, "draft", "2026-02-01", "x", head)
    events = [("a", "n1", 1, "draft", "2026-02-01", "x", head), ("a", "n2", 2, "draft", "2026-02-01", "y", ahead), ("a", "n3", 3, "draft", "2026-02-01", "z", head), ("new", "n4", 1, "init", "2026-02-01", None, GENESIS)]
    got = {r.event_id: (r.seq, r.problem) for r in process.appended(log, spark.createDataFrame(events, EVENT)).collect()}
    assert got == {"n1": (7, None), "n2": (8, None), "n3": (None, "fork"), "n4": (1, None)}


def test_faults_stop_a_log_and_a_restart_carries_assistance_on(spark):
    def log(name):
        return chain([(name, f"{name}{k}", k, "assist" if k in (2, 5) else "draft", "2026-01-01", str(k), None) for k in range(8)])

    fork, gap, link, content, sound, number = (log(x) for x in ("fork", "gap", "link", "content", "sound", "number"))
    fork.append((*fork[4][:5], "other", fork[4][6], digest(5, "draft", "2026-01-01", "other", fork[4][6])))
    del gap[3]
    link[3] = (*link[3][:6], "elsewhere", digest(4, *link[3][3:6], "elsewhere"))
    content[3] = (*content[3][:5], "changed", *content[3][6:])
    number[7] = (number[7][0], None, *number[7][2:])
    entries = spark.createDataFrame(fork + gap + link + content + sound + number, process.ENTRY).cache()
    found = sorted((r.log_id, r.seq, r.fault) for r in process.faults(entries).collect() if r.seq)
    assert found == [("content", 4, "content"), ("fork", 5, "fork"), ("gap", 5, "gap"), ("link", 4, "link"), ("link", 5, "link")]
    assert {(r.log_id, r.fault) for r in process.faults(entries).where("seq is null").collect()} == {("number", "number"), ("number", "content")}
    heads = {r.log_id: r for r in process.heads(entries).collect()}
    assert {k: h.good for k, h in heads.items()} == {"fork": 4, "gap": 3, "link": 3, "content": 3, "sound": 8, "number": 0}
    assert heads["gap"].good_hash == gap[2][-1] and heads["number"].good_hash == GENESIS
    events = spark.createDataFrame([(k, "late", 99, "draft", "2026-03-01", "more", None) for k in heads], EVENT)
    assert {r.log_id: r.problem for r in process.appended(entries, events).collect()} == {k: None if k == "sound" else "broken" for k in heads}
    new = process.restarted(entries, F.lit("disk failed"), F.lit("2026-04-01")).cache()
    assert process.faults(new).collect() == []
    by = {}
    for r in sorted(new.collect(), key=lambda r: r.seq):
        by.setdefault(r.log_id, []).append((r.kind, r.body))
    assert set(by) == {f"{k}+" for k in heads if k != "sound"}
    assert by["gap+"] == [("continuation", f'{{"continues":"{gap[2][-1]}","good":3,"reason":"disk failed"}}'), ("assist", "2"), ("assist", "5")]
    told = {r.log_id: (r.refused, r.drafts, r.assists, r.statement) for r in process.exported(entries.unionByName(new)).collect()}
    assert told["sound"] == (None, 6, 2, "Worked on over 1 days, 2026-01-01 to 2026-01-01: 6 drafts; assistance was recorded 2 times.")
    assert told["gap"][0] == "fault at entry 5" and told["gap"][3] is None and told["gap+"][0] is None


def test_reveals_verify_salted_commitments(spark):
    salt = "00ff10"
    frame = spark.createDataFrame([(salt, "secret plan")], "s string, t string")
    commitment = frame.select(values.commitment(F.col("s"), F.col("t"))).first()[0]
    events = [("a", "1", 1, "note", "2026-01-01", f'{{"commitment":"{commitment}"}}', None), ("a", "2", 2, "draft", "2026-01-01", "plain", None)]
    entries = chain(events) + [(*e[:5], "changed", *e[6:]) for e in chain([("b", *events[0][1:])])]
    reveals = [("a", 1, salt, "secret plan"), ("a", 1, salt, "other plan"), ("a", 1, "01", "secret plan"), ("a", 2, salt, "plain"), ("a", 3, salt, "x"), ("b", 1, salt, "secret plan"), ("a", 1, None, None)]
    found = process.revealed(spark.createDataFrame(entries, process.ENTRY), spark.createDataFrame(reveals, "log_id string, seq long, salt string, text string")).collect()
    assert sorted((r.log_id, r.seq, r.verdict) for r in found) == sorted([("a", 1, "verified"), *[("a", 1, "other text")] * 3, ("a", 2, "no commitment"), ("a", 3, "no entry"), ("b", 1, "broken")])


def test_batches_of_a_stream_are_appended_once(spark, tmp_path):
    path, source = f"{tmp_path}/logs", f"{tmp_path}/events"
    first, second = some(5, 40), [(*e[:1], "s" + e[1], e[2] + 100, *e[3:]) for e in some(6, 30)]
    for number, events in enumerate((first, second, first)):
        process_log.append(spark.createDataFrame(events, EVENT), number, path)
    process_log.append(spark.createDataFrame(second, EVENT), 1, path)  # a replay after a failure
    assert rows(process_log.logs(spark, path)) == chain(first + second)
    assert {(r.batch, r.problem): r["count"] for r in spark.read.parquet(f"{path}/refused").groupBy("batch", "problem").count().collect()} == {(2, "known"): 40}
    spark.createDataFrame(first, EVENT).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(EVENT).parquet(source)
    process_log.writer(stream, f"{tmp_path}/streamed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert rows(process_log.logs(spark, f"{tmp_path}/streamed")) == chain(first)
