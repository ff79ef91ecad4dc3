"""The check reads, marks and scans its documents once, for whatever follows and for all profiles of one reading."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import check, lines, metrics
from proseloom.plans import fixtures

OPENS = "She did not see the river. She did see the river. She ran on over hills. "


def _documents(spark):
    told = [f"{OPENS}\n\n`{x}` and {x}\n\n```\n{x}\n```\n" for x in fixtures.RULE_LINES if x] + ["writing-allow: delve\nWe delve https://a.b/c <b>{x}", "", None, "---\na: 1\n---\nStrong foundation. x@y.zz"]
    return spark.createDataFrame(list(enumerate(told)), "doc_id long, text string").repartition(1)


def _plan(frame) -> str:
    return frame._jdf.queryExecution().analyzed().toString()


def test_profiles_of_one_reading(spark):
    documents = _documents(spark)
    profiles = [check.Profile(name="a", slop="off", promote=("em-dash", "list-reflex")), check.Profile(name="b", slop="strict")]
    both = {(r.profile, r.doc_id): r for r in check.checks(documents, profiles).collect()}
    for p in profiles:
        alone = check.check(documents, p).collect()
        assert len(alone) == documents.count() and all(both[p.name, r.doc_id] == r for r in alone)
    assert {r.gate for r in both.values()} == {"ok", "blocked"}
    with pytest.raises(ValueError):
        check.checks(documents, [profiles[0], check.Profile(fiction=True)])


def test_check_marks_its_lines_once(spark):
    assert "https?://" not in _plan(check.check(_documents(spark)))


def test_marked_lines_are_the_prose_lines(spark):
    documents = _documents(spark)
    rows = lambda frame: sorted(map(tuple, frame.select("doc_id", "line", "start", "raw", "masked").collect()))
    assert rows(lines.prose(documents)) == rows(lines.prose(documents, told=lines.marked(documents)))


def test_needs_of_markup_lose_no_mask(spark):
    kept = spark.createDataFrame([(x,) for x in ("a `b` c", "ftp https://x y", "to a.b@c.de now", "<b>x</b>", r"\emph{x}", "x} {y", "plain")], "t string")
    for pattern, needs in zip(text.MARKUP, text.MARKUP_NEEDS, strict=True):
        assert kept.where(text.blanked(F.col("t"), pattern) != text.blanked(F.col("t"), pattern, needs)).isEmpty()


def test_cadence_reads_the_words_of_its_sentences_once(spark):
    plan = _plan(metrics.cadence(_documents(spark)))
    assert plan.count(text.WORD) == 2  # of the lines, and of the sentences
