"""Voice sheets: each check by a worked line, patterns refused, and many sheets as few."""

from __future__ import annotations

import pytest

from proseloom.operators import sheets

ANN = ("Ann", ["Annie"], ["damn", "C++"], [("(?i)you know$", "trails off"), ("(a+)+b", None), ("(", None), (r"(x)\1", None), ("z" * 301, None)], [(["letter", "gate"], "read in act 3", ["act3"])], ["aye"], ["on the turn"], 1, 6, False, "never")
BOB = ("BOB", None, None, None, None, None, None, None, None, None, "only")
LINES = [
    (1, "ann", "Damn the boats.", None), (2, "ANNIE", "We sail, you know", None), (3, "Ann", "It's late.", None), (4, "Ann", "Who goes?", None), (5, "Ann", "The letter came by the gate.", None), (6, "Ann", "The letter came.", "act3"),
    (7, "Ann", 'He said "damn, who goes?" and left.', None), (8, "Ann", "This one is far too long for her. Short one.", None), (9, "bob", "Is it?", None), (10, "Bob", "It is.", None), (11, "Cy", "damn?", None), (12, "Ann", None, None), (13, "Ann", "C++ is damned fine.", None), (14, None, "damn", None),
]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(LINES, "line_id long, speaker string, text string, group string").repartition(3), spark.createDataFrame([ANN, BOB], sheets.SCHEMA)


def test_each_check_by_a_worked_line(frames):
    got = sorted((r.line_id, r.name, r.check, r.excerpt) for r in sheets.findings(*frames).collect())
    assert got == [
        (1, "Ann", "never", "damn"), (2, "Ann", "never-pattern", "(?i)you know$"), (3, "Ann", "contractions", "It's"), (4, "Ann", "questions", "Who goes?"), (5, "Ann", "knowledge-leak", "letter, gate"),
        (8, "Ann", "sentence-length", "8"), (10, "BOB", "questions", "It is."), (13, "Ann", "never", "C++"),
    ]
    labels = {r.line_id: (r.label, r.weight) for r in sheets.findings(*frames).collect()}
    assert labels[2] == ("trails off", 2) and labels[5] == ("mentions what the character should not know: read in act 3", 3) and labels[8] == ("sentence length outside 1 to 6 words", 1)


def test_patterns_are_tried_before_use(frames):
    assert sorted((r.re[:5], r.reason) for r in sheets.refused(frames[1]).collect()) == [("(", "no pattern"), ("(a+)+", "slow"), (r"(x)\1", "slow"), ("zzzzz", "too long")]


def test_speakers_without_a_sheet_are_kept(frames):
    lines, told = frames
    gates = {r.speaker: (r.lines, r.flagged, r.gate) for r in sheets.gate(lines, told).collect()}
    assert gates["Cy"] == (1, 0, "unknown") and gates[None] == (1, 0, "unknown") and gates["ann"] == (1, 1, "blocked") and gates["bob"] == (1, 0, "ok") and gates["Ann"] == (8, 3, "blocked")
    uses = {r.speaker: (r.name, r.lines, r.tic_lines) for r in sheets.usage(lines, told).collect()}
    assert uses["Cy"] == (None, 1, None) and uses["Ann"] == ("Ann", 8, 0.0)


def test_many_sheets_are_joined_as_few_are(frames, monkeypatch):
    few = sorted(map(tuple, sheets.findings(*frames).collect()))
    monkeypatch.setattr(sheets, "MOST_NAMES", 3)
    many = frames[1].unionByName(frames[1].selectExpr("concat(name, 'x') name", "aliases", "never", "cast(null as array<struct<re:string,msg:string>>) never_patterns", "unknown", "markers", "tics", "least_words", "most_words", "contractions", "questions"))
    assert sorted(map(tuple, sheets.findings(frames[0], many).collect())) == few
    assert sheets.findings(frames[0].limit(0), frames[1]).collect() == [] and sheets.findings(frames[0], frames[1].limit(0)).collect() == []
