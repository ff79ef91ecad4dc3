"""Plans, submissions and the change report: tokens, gates, and findings that sum to both sides."""

from __future__ import annotations

from collections import Counter

import pytest

from proseloom.operators import check, editplan

SECRET, STRICT = "k3y", check.Profile(slop="strict")
TEXTS = ["Moreover, it held. A plain line.\n\nThe cost is $5 million in 2020.", "A plain line about a dog.", None, "We delve into it.\n\nAs an AI language model I cannot say."]
KIND = "doc_id long, plan_id string, rewrite string"


@pytest.fixture(scope="module")
def planned(spark):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return documents, {r.doc_id: r for r in editplan.plans(documents, SECRET, STRICT).collect()}


def test_plans_name_what_is_to_mend(planned):
    _, plans = planned
    assert {k: p.gate for k, p in plans.items()} == {0: "blocked", 1: "ok", 2: "ok", 3: "blocked"}
    assert all(TEXTS[k][f.start : f.end] == f.match for k, p in plans.items() for f in p.findings)
    assert len({p.plan_id for p in plans.values()}) == 4


def test_submissions_are_bound_to_their_plan(spark, planned):
    documents, plans = planned
    ids = {k: p.plan_id for k, p in plans.items()}

    def sent(rows, docs=documents, **more):
        return {r.doc_id: (r.status, r.reason, r.text, r.gate_before, r.gate_after, r.refused) for r in editplan.submitted(docs, spark.createDataFrame(rows, KIND), more.pop("secret", SECRET), more.pop("profile", STRICT), **more).collect()}

    good = TEXTS[0].replace("Moreover, it held.", "It held.").replace("$5 million", "$5M")
    lost = good.replace("$5M", "$6 million")
    texts = [TEXTS[0], TEXTS[0], TEXTS[1], TEXTS[1], TEXTS[3]]
    many = spark.createDataFrame([(10 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    own = {r.doc_id: r.plan_id for r in editplan.plans(many, SECRET, STRICT).collect()}
    new = [good, lost, TEXTS[1], "Moreover, a plain line about a dog.", "Moreover, we look into it.\n\nFurthermore, as an AI language model I cannot delve."]
    assert sent([(10 + k, own[10 + k], t) for k, t in enumerate(new)], many) == {
        10: ("accepted", None, good, "blocked", "ok", []),
        # a paragraph that loses a fact stands as it was
        11: ("accepted", None, TEXTS[0].replace("Moreover, it held.", "It held."), "blocked", "ok", [1]),
        12: ("unchanged", None, TEXTS[1], "ok", "ok", []),
        13: ("refused", "more blocking findings than before", TEXTS[1], "ok", "ok", []),
        14: ("refused", "more blocking findings than before", TEXTS[3], "blocked", "blocked", []),
    }
    # another text, other settings, another secret, another document's plan, no plan at all
    newer = spark.createDataFrame([(0, TEXTS[0] + " More.")], "doc_id long, text string")
    assert sent([(0, ids[0], good)], newer)[0][:3] == ("stale", "text", TEXTS[0] + " More.")
    assert sent([(0, ids[0], good)], profile=check.Profile())[0][:2] == ("stale", "settings")
    assert sent([(0, ids[0], good)], freeze=("held",))[0][:2] == ("stale", "settings")
    assert sent([(0, ids[0], good)], secret="other")[0][:2] == ("forged", None)
    assert {k: v[0] for k, v in sent([(0, ids[1], good), (1, None, "x"), (3, ids[3][:-1] + ("0" if ids[3][-1] != "0" else "1"), "y")]).items()} == {0: "forged", 1: "forged", 3: "forged"}


PAIRS = [
    (0, "Moreover, it held. One. Two.\n\nSame here.", "It held. One. We delve. Two.\n\nSame here."),
    (1, "Moreover, it held. Moreover, it stood.", "Moreover, it stood."),
    (2, "One.\n\nTwo.", "One. Two. Moreover, three."),
    (3, None, "Moreover, new."),
    (4, "A plain line.", "A plain line."),
    (5, "Firstly, we begin. Rest assured, it ends.", "Firstly, we end. Rest assured, it  ends."),
]


def test_findings_sum_to_both_sides(spark):
    pairs = spark.createDataFrame(PAIRS, "doc_id long, original string, rewrite string")
    p = check.Profile()
    rows = editplan.tally(pairs, p).collect()
    for column, kept in (("original", "gone"), ("rewrite", "added")):
        want = Counter((r.doc_id, r.rule_id) for r in check.findings(pairs.selectExpr("doc_id", f"{column} as text"), p).collect())
        got = Counter()
        for r in rows:
            got[r.doc_id, r.rule_id] += r[kept] + r.remaining
        assert +got == want


def test_changes_show_sentences_in_order(spark):
    pairs = spark.createDataFrame(PAIRS, "doc_id long, original string, rewrite string")
    found = {}
    for r in sorted(editplan.changes(pairs).collect(), key=lambda r: (r.doc_id, r.record)):
        name = lambda xs: [x.rule_id.split("/")[0] for x in xs]
        found.setdefault(r.doc_id, []).append((r.paragraph, r.op, r.before, r.after, bool(name(r.gone)), bool(name(r.added))))
    assert found[0] == [(0, "replace", "Moreover, it held.", "It held.", True, False), (0, "insert", "", "We delve.", False, True)]
    assert found[1] == [(0, "delete", "Moreover, it held.", "", True, False)]
    assert found[2] == [(0, "insert", "", "Moreover, three.", False, True)]
    assert found[3] == [(0, "insert", "", "Moreover, new.", False, True)]
    assert 4 not in found and found[5] == [(0, "replace", "Firstly, we begin.", "Firstly, we end.", False, False)]
    for r in editplan.records(pairs).collect():
        _, b, a = PAIRS[r.doc_id]
        assert r.before == (b[r.b_start : r.b_end].rstrip() if r.b_start is not None else "") and r.after == (a[r.a_start : r.a_end].rstrip() if r.a_start is not None else "")
    assert editplan.changes(pairs.limit(0)).collect() == []


def test_both_sides_meet_by_exchange(spark, monkeypatch):
    """Findings and records are not written small, to be broadcast then: they meet by document."""
    found = spark.createDataFrame([(1, 0, "x/y"), (1, 25, "x/y"), (2, 5, "x/y")], "doc_id long, start long, rule_id string")
    monkeypatch.setattr(editplan.C, "findings", lambda documents, p: found.join(documents.select("doc_id"), "doc_id", "left_semi"))
    monkeypatch.setattr(editplan, "written", None)
    told = editplan.tally(spark.createDataFrame([p for p in PAIRS if p[0] in (1, 2)], "doc_id long, original string, rewrite string"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and "FullOuter" not in plan
    rows = {(r.doc_id, r.record, r.rule_id): (r.gone, r.remaining, r.added) for r in told.collect()}
    # text 1 is 38 and 19 characters long: 25 lies in its second sentence, and in no sentence of the rewrite
    assert rows == {(1, 0, "x/y"): (1, 0, 0), (1, 1, "x/y"): (0, 1, 0), (1, -1, "x/y"): (0, 0, 1), (2, 0, "x/y"): (0, 1, 0)}
