"""Proposals move sentences word for word; anything lost, changed or doubled is refused."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from proseloom.operators import restructure, series

KEPT = ["They found the gate.", "Rain fell all day!", "The mill stands empty.", "It was closed, and nobody came."]
MOVES = ["According to the almanac, it rained.", "Confidence: high.", "This does not prove the claim.", "See https://a.example/x."]
PLAIN = "It was found. According to the almanac, it rained. Confidence: high. They left.\n\n# Head\n\n- item. Sources: none.\n\nShort one. This does not show more. Edited with care, sources: own."


def proposals(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in restructure.proposed(frame).collect()}


def check(spark, pairs):
    return {r.doc_id: r for r in restructure.verified(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "doc_id long, original string, proposal string")).collect()}


def test_a_worked_proposal(spark):
    found = proposals(spark, [PLAIN, None, "Only claims here. And here.", "According to X, it is. So it is.", "Sources: one. Confidence: high."])
    a, b = (m.id for m in found[0].moved)
    assert [m.text for m in found[0].moved] == ["According to the almanac, it rained. Confidence: high.", "This does not show more."]
    body = f"It was found.[^m-{a}] They left.\n\n# Head\n\n- item. Sources: none.\n\nShort one.[^m-{b}] Edited with care, sources: own."
    assert found[0].proposal == f"{body}\n\n## Sources and method\n\n[^m-{a}]: According to the almanac, it rained. Confidence: high.\n\n[^m-{b}]: This does not show more.\n"
    assert [(found[k].proposal, found[k].moved) for k in (1, 2, 3, 4)] == [("", []), ("Only claims here. And here.", []), ("According to X, it is. So it is.", []), ("Sources: one. Confidence: high.", [])]
    assert proposals(spark, [found[0].proposal])[0].moved == []


def test_proposals_are_accepted_and_any_change_is_refused(spark):
    rng = random.Random(4)
    texts = ["\n\n".join(" ".join(rng.choice(KEPT + MOVES) + rng.choice(["", "", " Then more " + str(rng.randrange(999)) + "."]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    made = proposals(spark, texts)
    assert sum(bool(r.moved) for r in made.values()) > 30
    assert all(r.ok for r in check(spark, [(t, made[k].proposal) for k, t in enumerate(texts)]).values())
    pairs = []
    for k, t in enumerate(texts):
        if not made[k].moved:
            continue
        new, sentences = made[k].proposal, re.findall(r"[A-Z][^.!?\n\[]*[.!?]", made[k].proposal)
        one = rng.choice(sentences)
        first = made[k].moved[0].id
        pairs += [(t, x) for x in (
            new.replace(one, "", 1), new.replace(one, one + " " + one, 1), new.replace(one, one.replace(one.split()[0], "Other", 1), 1), new.replace(f"[^m-{first}]", "", 1),
            new.replace(f"[^m-{first}]: ", "[^m-00000000]: "), new + f"\n\n[^m-{first}]: Again.\n", new.replace("\n\n", " ", 1), new + "\n\nAn added sentence.",
        )]
    found = check(spark, pairs)
    assert not [pairs[k] for k, r in found.items() if r.ok]
    assert {x for r in found.values() for x in r.reasons} >= {"an anchor has no entry", "an entry has no anchor", "an entry appears more than once", "sentences were lost, added, doubled or changed", "the number of paragraphs changed"}


def test_entries_that_change_places_are_refused(spark):
    made = proposals(spark, [PLAIN])[0].proposal
    a, b = re.findall(r"\[\^m-([0-9a-f]{8})\]:", made)
    swapped = made.replace(a, "x" * 8).replace(b, a).replace("x" * 8, b)
    swapped = swapped.split("## Sources")[0].replace(a, "y" * 8).replace(b, a).replace("y" * 8, b) + "## Sources" + swapped.split("## Sources")[1]
    found = check(spark, [(PLAIN, swapped), (PLAIN, made), (None, None)])
    assert found[0].reasons == ["the text does not read as it did with its entries put back"] and found[1].ok and found[2].ok


def test_paragraphs_that_hold_no_move_are_left_out_and_nothing_is_joined(spark):
    moving = ["This does\nnot  prove it.", "It doesn't show that.", "See (high).", "x: Low", " -- Unknown --", "a https://b.c", "xhttps://b.c", "[a](b)", "According  to it", "It reports", "Source: x", "as [12] says", "[^1]", "Per the rule", "What this does not", "a does-not-prove", "This is not evidence", "my Confidence"]
    still = ["Flow below highland reporter", "nothing", "This does it.", "hot water"]
    frame = spark.createDataFrame([(x,) for x in moving + still], "t string").select("t", F.col("t").rlike(restructure.MAY_MOVE).alias("may"), series.move(F.col("t")).isin(*restructure.MOVED).alias("moves"))
    told = {r.t: (r.may, r.moves) for r in frame.collect()}
    assert all(told[x] == (True, True) for x in moving) and not any(told[x][0] for x in still)
    documents = spark.createDataFrame([(1, "A b.\n\nThe gate shut. According to x, it rained. The mill stood."), (1, "Only this."), (None, None)], "doc_id long, text string")
    found = restructure.proposed(documents, ("text",))
    judged = restructure.verified(found.withColumnRenamed("text", "original"), ("moved",))
    assert sorted((r.doc_id or 0, r.ok, len(r.moved)) for r in judged.collect()) == [(0, True, 0), (1, True, 0), (1, True, 1)]
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()
    lost = restructure.verified(found.select("doc_id", F.col("text").alias("original"), F.replace("proposal", F.lit("mill"), F.lit("barn")).alias("proposal")))
    assert sorted(len(r.reasons) for r in lost.collect()) == [0, 0, 2]
