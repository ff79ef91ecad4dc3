from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proseloom.operators import campaign, compare, components, devices, dialogue, edits, evaluate, negation, receipts, series, voice
from proseloom.plans import fixtures
from proseloom.sources import readers, sinks


def test_clusters(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank at dawn"
    rows = [(1, base), (2, base.upper()), (3, base + " today"), (4, "nothing alike here at all, my friend"), (5, None), (6, "")]
    found = {r.id: r for r in campaign.clusters(spark.createDataFrame(rows, "id long, text string"), 0.7).collect()}
    assert set(found) == {1, 2, 3} and {r.cluster for r in found.values()} == {1} and found[1].size == 3


def test_exact_and_hashed_pairs_agree_when_close(spark):
    rows = [(i, f"a text that differs little from text {i % 3} of the series, and goes on for a while") for i in range(9)] + [(20, "far away")]
    items = spark.createDataFrame(rows, "id long, text string")
    pairs = lambda lsh: {(r.a, r.b) for r in campaign.similar_pairs(items, 0.8, lsh).collect()}
    assert pairs(True) == pairs(False) == {(0, 1), (0, 2), (1, 2)}


def test_shingles_are_of_code_points(spark):
    bodies = ["\U0001f600ab\U0001f601cd\nef", "abcd", "abcde", "", "\U0001f600" * 7, "größe ß"]
    found = spark.createDataFrame([(b,) for b in bodies], "b string").select(F.col("b"), campaign.shingles(F.col("b")).alias("s")).collect()
    assert {r.b: set(r.s) for r in found} == {b: ({b[k : k + 5] for k in range(len(b) - 4)} or ({b} if b else set())) for b in bodies}


def test_exact_pairs_match_brute_force(spark):
    """At any threshold, those that MinHash would mostly miss included."""
    rng = random.Random(3)
    base = [rng.choice("abcdefgh ") for _ in range(60)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(60)] = rng.choice("abcdefgh ")
        rows.append((i, "".join(own)))
    items = spark.createDataFrame(rows, "id long, text string")
    sets = {}
    for i, t in rows:
        body = re.sub(r"\s+", " ", t).strip()
        sets.setdefault(body, (i, {body[k : k + 5] for k in range(len(body) - 4)}))
    ids = sorted(sets.values())
    for threshold in (0.2, 0.5, 0.8):
        want = {(a, b) for a, x in ids for b, y in ids if a < b and len(x & y) / len(x | y) >= threshold}
        assert want and {(r.a, r.b) for r in campaign.similar_pairs(items, threshold).collect()} == want


def test_few_pairs_are_compared(spark):
    """Texts of one small vocabulary share most shingles; only those that can be alike are compared."""
    rng = random.Random(8)
    words = [a + b for a in "bdfgklmnprst" for b in ("an", "ex", "or", "ung")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(150)]
    rows += [(1000 + i, t.replace(" ", "  ", 3).split(" ", 1)[1]) for i, t in rows[:20]]
    items = spark.createDataFrame(rows, "id long, text string")
    distinct = items.select("id", campaign.shingles(campaign.normalised(F.col("text"))).alias("shingles"))
    compared = campaign.candidates(distinct, 0.8).count()
    found = {(r.a, r.b) for r in campaign.similar_pairs(items, 0.8).collect()}
    assert found == {(i, 1000 + i) for i in range(20)} and compared < 0.15 * (170 * 169 / 2)


def test_pairs_are_dealt_into_bounded_cells_and_none_is_lost(spark, monkeypatch):
    """Texts of many lengths in one small vocabulary, cut into many cells: all pairs of a plain loop, and few rows leave the cells."""
    monkeypatch.setattr(campaign, "CELL_ROWS", 20)
    monkeypatch.setattr(campaign, "LEAST_ROWS", 5)
    rng = random.Random(11)
    words = [a + b for a in "bdfgkl" for b in ("an", "ex", "or")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 33, 36, 200])))) for i in range(150)]
    rows += [(1000 + i, t.rsplit(" ", rng.randint(1, 6))[0]) for i, t in rows] + [(5000, "ab"), (5001, "abcdefg")]
    sets = {}
    for i, t in rows:
        sets.setdefault(t, (i, {t[k : k + 5] for k in range(len(t) - 4)} or {t}))
    ids = sorted(sets.values())
    items = spark.createDataFrame(rows, "id long, text string")
    distinct = items.groupBy("text").agg(F.min("id").alias("id")).select("id", campaign.shingles(F.col("text")).alias("shingles"))
    for threshold in (0.4, 0.8, 1.0):
        want = {(a, b) for a, x in ids for b, y in ids if a < b and len(x & y) / len(x | y) >= threshold}
        assert {(r.a, r.b) for r in campaign.similar_pairs(items, threshold).collect()} == want
        passed = [(r.a, r.b) for r in campaign.candidates(distinct, threshold).collect()]
        assert len(passed) == len(set(passed)) and want <= set(passed)


def test_passages_count_documents_that_hold_them_inside_longer_runs(spark):
    words = [f"{a}{b}stone" for a in "bcdfg" for b in "aeiou"]
    part = lambda lo, hi: " ".join(words[lo:hi])
    rows = [(1, "one " + part(0, 12) + " two"), (2, part(0, 20)), (3, "three " + part(0, 20)), (4, part(6, 20) + " four")]
    found = {(r.passage, r.words, r.docs) for r in series.maximal_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(part(0, 12), 12, 3), (part(6, 20), 14, 3)}
    two = {(r.passage, r.docs) for r in series.maximal_ngrams(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}
    assert two == {(part(0, 12), 2)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(31)) and roots[102] == 100
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_negation(spark):
    found = {r.entry_id: r for r in negation.load(fixtures.entries(spark)).collect()}
    assert found[1].verdict == "fail" and found[1].score == 1.0
    assert found[2].verdict == "ok" and found[2].negation_clauses == 0
    assert 4 not in found and found[5].virtue >= 3



def test_attribution(spark):
    lines = []
    for i in range(60):
        who = ("ANN", "BOB", "CY")[i % 3]
        lines.append((i, who, {"ANN": "boats and tides today", "BOB": "iron rails again tomorrow", "CY": "salt bread with honey"}[who] + f" n{i % 4}"))
    found = dialogue.attribution(spark.createDataFrame(lines, "line_id long, speaker string, text string")).collect()
    assert len(found) == 60 and all(r.rank == 1 and r.top == r.speaker and 0.3 < r.p_true <= 1 for r in found)
    acc = dialogue.accuracy(dialogue.attribution(spark.createDataFrame(lines, "line_id long, speaker string, text string"))).collect()
    assert all(r.accuracy == 1.0 and 0 < r.low < 1 == r.high for r in acc)


def test_wilson_and_auroc(spark):
    frame = spark.createDataFrame([(0, 0), (8, 10)], "k long, n long")
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    rows = frame.select(low.alias("low"), high.alias("high")).collect()
    assert (rows[0].low, rows[0].high) == (0.0, 1.0)
    assert math.isclose(rows[1].low, 0.4901, abs_tol=1e-3) and math.isclose(rows[1].high, 0.9433, abs_tol=1e-3)
    data = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (None, 0.3), (1, 0.9)]
    found = evaluate.auroc(spark.createDataFrame(data, "y long, s double"), "y", "s").first()
    pairs = [(a, b) for y, a in data if y == 1 for z, b in data if z == 0]
    assert math.isclose(found.auroc, sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))


def test_nearest_rank(spark):
    for values, percent in (([3.0, 1.0, 2.0], 50), (list(map(float, range(11))), 10), ([5.0], 90), ([1.0, 2.0, 3.0, 4.0], 50)):
        got = spark.range(1).select(evaluate.nearest_rank(F.lit(values), percent)).first()[0]
        assert got == sorted(values)[round(percent / 100 * (len(values) - 1))]


def test_compare(spark):
    pairs = [
        (1, "It costs $5 and must run in 20 ms at https://a.io.", "It costs $6 and should run in 20 ms at https://a.io."),
        (2, "We saw Ann.", "We did not see anyone."),
        (3, "Same `code` and 3 cats.", "Same `code` and 3 cats."),
        (4, None, ""),
    ]
    frame = spark.createDataFrame(pairs, "doc_id long, original string, rewrite string")
    counts = Counter((r.doc_id, r.kind, r.status) for r in compare.compare(frame).collect())
    assert counts[1, "number", "changed"] == 1 and counts[1, "number", "kept"] == 1 and counts[1, "modal", "changed"] == 1 and counts[1, "url", "kept"] == 1
    assert counts[2, "entity", "dropped"] == 1 and counts[2, "negation", "added"] == 1
    told = {r.doc_id: r.preserved for r in compare.verdicts(frame).collect()}
    assert told == {1: False, 2: False, 3: True, 4: True}
    kept = {r.doc_id: r for r in compare.guarded(frame).collect()}
    assert kept[1].refused and kept[1].text == pairs[0][1] and not kept[3].refused


def test_edits(spark):
    rows = [(1, "Moreover, the cat  sat — then left. `a  b` stays."), (2, None), (3, "- item  one"), (4, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in edits.transformed(docs, phrases=True).collect()}
    assert found == {1: "The cat sat, then left. `a  b` stays.", 2: "", 3: "- item one", 4: "plain"}
    made = edits.transformed(docs)
    assert {r.verdict for r in edits.verified(made, docs).collect()} == {"Match"}
    other = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))
    assert {r.verdict for r in edits.verified(made, other).collect()} == {"Drift"}


@pytest.mark.parametrize("redact", [None, "hash"])
def test_receipts(spark, redact):
    docs = spark.createDataFrame([(1, "This is not a bug but a feature. " + "A plain line about the day goes on and on. " * 5), (2, "Short.")], "doc_id long, text string")
    made = receipts.made(docs, redact=redact)
    assert {r.doc_id: r.result for r in receipts.verified(made, docs, redact=redact).collect()} == {1: "Match", 2: "Unverifiable"}
    changed = docs.withColumn("text", F.concat("text", F.lit("x")))
    assert {r.detail for r in receipts.verified(made, changed, redact=redact).collect()} == {"text does not match the receipt's text hash"}
    forged = made.withColumn("gate", F.lit("ok"))
    assert {r.doc_id: r.result for r in receipts.verified(forged, docs, redact=redact).collect()}[1] == "Drift"


def test_ledger(spark):
    rows = spark.createDataFrame([(1, i, "note", "2026-01-01", f"b{i}") for i in range(1, 6)], "log_id long, seq long, kind string, day string, body string").collect()
    chained, prev = [], receipts.GENESIS
    import hashlib

    for r in rows:
        own = "sha256:" + hashlib.sha256("\t".join((str(r.seq), r.kind, r.day, r.body, prev)).encode()).hexdigest()
        chained.append((*r, prev, own))
        prev = own
    schema = "log_id long, seq long, kind string, day string, body string, prev string, hash string"
    good = spark.createDataFrame(chained, schema)
    assert receipts.chain_problems(good).count() == 0 and receipts.last_good(good).first().good == 5
    forged = good.withColumn("body", F.when(F.col("seq") == 3, "other").otherwise(F.col("body")))
    assert [(r.seq, r.problem) for r in receipts.chain_problems(forged).collect()] == [(3, "content does not match its hash")]
    assert receipts.last_good(forged).first().good == 2
    gap = good.where("seq != 2")
    assert {r.problem for r in receipts.chain_problems(gap).where("seq = 3").collect()} == {"sequence number out of order", "does not link to the entry before it"}


def test_series(spark):
    body = "# T\n\n## Start\n\none two three four five\n\n## Middle\n\none two three four five\n\n## Later\n\nsix seven eight nine ten\n\n## End\n\nsix seven eight nine ten\n"
    docs = spark.createDataFrame([(1, body), (2, body), (3, "## Start\n\nonly this"), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in series.even_sections(docs).collect()} == {1, 2}
    assert {r.heading: r.docs for r in series.heading_overlap(docs).collect()} == {"start": 3, "middle": 2, "later": 2, "end": 2}
    passage = "a quiet harbour holds seven grey boats tonight"
    shared = spark.createDataFrame([(i, f"x{i} {passage} y{i}") for i in range(3)], "doc_id long, text string")
    assert [(r.passage, r.words, r.docs) for r in series.maximal_ngrams(shared).collect()] == [(passage, 8, 3)]


def test_voice_and_devices(spark):
    docs = spark.createDataFrame([(i, "We came, we saw, and we won. Boats sail slowly. Boats sail quickly home again now.") for i in range(3)] + [(9, "tiny")], "doc_id long, text string")
    measured = voice.features(docs)
    assert measured.where("doc_id = 9").first().commas is None
    profile = voice.profile(measured.withColumn("writer", F.lit("w")))
    assert {r.share for r in voice.fit(measured.where("doc_id < 9"), profile).collect()} == {1.0}
    assert {"anaphora"} <= {r.device for r in devices.read(docs).collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.png").write_bytes(b"\x89PNG123")
    (tmp_path / "c.txt").write_bytes(b"\x7fELF")
    (tmp_path / "d.txt").write_bytes(b"nul\x00byte")
    found = {r.path.rsplit("/", 1)[1]: r for r in readers.files(spark, str(tmp_path)).collect()}
    assert found["a.md"].text == "one\ntwo" and found["a.md"].refused is None
    assert found["b.png"].refused == "extension .png" and found["c.txt"].refused == "ELF signature" and found["d.txt"].refused == "NUL byte"
    paths = spark.createDataFrame([("docs/a.md",), ("src/x/y.py",), ("z.md",)], "p string")
    assert [r[0] for r in paths.select(readers.routed(F.col("p"), [("docs/**", "doc"), ("*.py", "code")])).collect()] == ["doc", "code", "default"]
    page = spark.createDataFrame([(1, "<p>One &amp; two<p>Three<script>no</script><ul><li>a<li>b</ul>"), (2, None)], "page_id long, html string")
    assert [(r.tag, r.text) for r in readers.html_entries(page).orderBy("n").collect()] == [("p", "One & two"), ("p", "Three"), ("li", "a"), ("li", "b")]
    script = spark.createDataFrame([(1, "ANN: Hello there\nand more\nBOB. Yes, I do.")], "doc_id long, text string")
    assert [(r.speaker, r.text) for r in readers.script_lines(script).orderBy("line").collect()] == [("ANN", "Hello there"), ("ANN", "and more"), ("BOB", "Yes, I do.")]
    mail = spark.createDataFrame([(1, "first\n---\nsecond\n----\n\n")], "doc_id long, text string")
    assert [r.text for r in readers.messages(mail).orderBy("message").collect()] == ["first", "second"]
    data = spark.createDataFrame([(1, '{"a": "one two three four", "b": {"c": "five six seven eight"}, "d": 3}'), (2, "broken")], "doc_id long, text string")
    assert {(r.path, r.text) for r in readers.json_entries(data).collect()} == {("a", "one two three four"), ("b.c", "five six seven eight")}


def test_sinks(spark):
    import json

    from proseloom.operators import scan

    found = scan.line_findings(fixtures.rule_lines(spark))
    log = json.loads(sinks.sarif(found).where("doc_id = 0").first().sarif)
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["ruleId"].startswith("antithesis/")
    first = sinks.diagnostics(found).where("doc_id = 0").first()
    assert first.line == 0 and first.severity == 1
    assert "match" not in sinks.redacted(found).columns


def test_attribution_equals_plain_loops(spark):
    rng = random.Random(12)
    words = {s: [f"{s.lower()}{k}" for k in range(4)] + ["the", "and", "so"] for s in ("ANN", "BOB", "CY")}
    lines = [(i, s, " ".join(rng.choice(words[rng.choice([s, s, "ANN"])]) for _ in range(rng.randint(0, 5))) + rng.choice(["", "?", "!", ", so"])) for i, s in enumerate(rng.choice("ANN BOB CY".split()) for _ in range(75))]
    lines += [(200, None, "no one"), (201, "RARE", "once")]
    frame = spark.createDataFrame(lines, "line_id long, speaker string, text string")
    got = {r.line_id: r for r in dialogue.attribution(frame).collect()}
    marks = [("?", "q"), ("!", "x"), (";", "s"), ("...", "e"), ("…", "e"), (",", "k")]

    def features(t):
        ws = [w.lower() for w in re.findall(dialogue.WORD, t)]
        joined = f" {' '.join(ws)} "
        return Counter([f"w:{w}" for w in ws] + [f"b:{a}_{b}" for a, b in zip(ws, ws[1:], strict=False)] + [f"c:{joined[i : i + 3]}" for i in range(len(joined) - 2)] + [f"p:{tag}" for m, tag in marks for _ in range(t.count(m))])

    of = {s: [x for x in lines if x[1] == s] for s in ("ANN", "BOB", "CY")}
    assert all(len(x) >= 20 for x in of.values())
    fold = {x[0]: k * 5 // len(xs) for xs in of.values() for k, x in enumerate(xs)}
    for line_id, speaker, body in (x for xs in of.values() for x in xs):
        trained = {s: sum((features(t) for i, _, t in xs if fold[i] != fold[line_id]), Counter()) for s, xs in of.items()}
        total = sum(trained.values(), Counter())
        score = {}
        for s in of:
            rest = total.total() - trained[s].total() + 0.5 * len(total)
            score[s] = -sum(k * math.log((total[f] - trained[s][f] + 0.5) / rest) for f, k in features(body).items())
        top = max(score.values())
        p = {s: math.exp(x - top) for s, x in score.items()}
        ranked = sorted(score, key=lambda s: (-round(score[s], 9), s))
        r = got.pop(line_id)
        assert r.speaker == speaker and r.top == ranked[0] and r.rank == ranked.index(speaker) + 1
        assert math.isclose(r.p_true, p[speaker] / sum(p.values()), rel_tol=1e-9)
    assert not got


def test_edits_of_a_long_text(spark):
    body = "é " + "One — two  and — three. " * 3000
    (row,) = edits.transformed(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()
    assert row.text == "é " + "One, two and, three. " * 3000 and len(row.edits) == 9000
