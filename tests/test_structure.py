"""Structure of Markdown, desk questions, terms, calibration and series runs, against plain loops."""

from __future__ import annotations

import base64
import difflib
import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from proseloom.functions import values
from proseloom.operators import calibrate, desk, evaluate, markdown, scan, series, terms
from proseloom.plans import fixtures
from proseloom.sources import sinks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_kinds(lines: list[str]) -> list[str]:
    """One line after the other, with the state at hand."""
    toml, fence, math, code, listed, after_blank, out = bool(lines) and lines[0] == "+++", False, False, False, False, True, []
    for i, line in enumerate(lines):
        width = 0
        for c in line[: len(line) - len(line.lstrip(" \t"))]:
            width = width + 1 if c == " " else width + 4 - width % 4
        kind = "text"
        if toml:
            kind, toml = "toml", not (i and line == "+++")
        elif re.match(r"\s*(```|~~~)", line):
            kind, fence, after_blank = "fence", not fence, False
        elif fence:
            kind = "fence"
        elif math or line.strip() == "$$":
            kind, math, after_blank = "math", math != (line.strip() == "$$"), False
        elif not line.strip():
            kind, after_blank = "blank", True
        elif width >= 4 and (code or after_blank and not listed):
            kind, code, after_blank = "code", True, False
        else:
            code, after_blank = False, False
            if re.match(markdown.LIST, line):
                listed = True
            elif width == 0:
                listed = False
            if "|" in line and re.match(markdown.DELIMITER_ROW, line) and "-" in line:
                kind = "delimiter"
        out.append(kind)
    return out


def test_line_kinds_match_a_plain_loop(spark):
    rng = random.Random(5)
    parts = ["+++", "```", "~~~ x", "$$", "", "  ", "    deep", "\tdeep", "     - deep list", "- item", " 1. item", "text", " text", "a | b", "|---|:-:|", "---", "  two", "        eight"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)] + ["+++\na = 1\n+++\ntext", "+++\nopen", "", None, "\n\n    code"]
    found: dict = {}
    for r in markdown.kinds(docs(spark, *texts)).collect():
        found.setdefault(r.doc_id, {})[r.line] = r.kind
    for i, t in enumerate(texts):
        lines = re.sub(r"\n\Z", "", t).split("\n") if t else []
        assert [found.get(i, {}).get(k + 1) for k in range(len(lines))] == plain_kinds(lines), t


def test_masks_keep_lengths(spark):
    rows = {r.raw: r.masked for r in markdown.masked(docs(spark, "cost $5 and $6\nlet $x^2$ be, $$y z$$ too\n| a |\n|--:|\n\n    code $a$")).collect()}
    assert rows["cost $5 and $6"] == "cost $5 and $6" and rows["let $x^2$ be, $$y z$$ too"] == "let       be,         too"
    assert rows["|--:|"] == "|   |" and not rows["    code $a$"].strip() and all(len(a) == len(b) for a, b in rows.items())


def test_desk_claims(spark):
    found = desk.claims(docs(spark, "Sales rose 12.5% in May. Studies show this.\n> It fell 3%.\nIt rose 4% (Smith 2020). <!-- 7% --> It cost 1,200 and 3.14 in all.", "Experts agree [3]. Version 1.2.3 of v2.", None, ""))
    assert {(r.doc_id, r.line, r.check, r.match) for r in found.collect()} == {
        (0, 1, "number-without-source", "12.5%"), (0, 1, "unsupported-authority", "Studies show"), (0, 3, "number-without-source", "1,200"), (0, 3, "number-without-source", "3.14"),
    }


def test_hidden_text(spark):
    texts = dict(fixtures.HIDDEN)
    found = desk.hidden(fixtures.hidden(spark)).collect()
    assert {(r.doc_id, r.kind, r.shown) for r in found} == {(-1, "comment", "<!-- not shown -->"), (-2, "invisible", "​"), (-2, "invisible", "hi"), (-3, "styled", '<p style="color:white">ghost'), (-3, "comment", "<!-- code -->")}
    assert all(len(texts[r.doc_id][r.start : r.end]) == len(r.shown) for r in found if r.kind != "invisible")


def test_missing_sections(spark):
    found = desk.missing_sections(docs(spark, "# Intro\n## Limitations #\n", "limitations", None)).collect()
    assert {(r.doc_id, r.section) for r in found} == {(1, "limitations"), (2, "limitations")}


def test_terms(spark):
    rules = [terms.Term("master list", use="main list"), terms.Term("C++", match_case=True), terms.Term("foo.bar", reason="old")]
    texts = ["A Master  list, a master-list and masters list.", "C++ and c++ but C++x", "foo.bar fooxbar `foo.bar`", None]
    found = terms.findings(docs(spark, *texts), rules).collect()
    assert sorted((r.doc_id, r.match, r.tier, r.rule_id) for r in found) == [
        (0, "Master  list", "MEDIUM", "terminology/preferred/main-list"), (1, "C++", "HIGH", "terminology/banned/c"), (2, "foo.bar", "HIGH", "terminology/banned/foo-bar"),
    ]
    assert all(texts[r.doc_id][r.start : r.end] == r.match for r in found)
    with pytest.raises(ValueError):
        terms.validated(rules, ("Foo.bar",))
    with pytest.raises(ValueError):
        terms.validated([terms.Term(" ")])


def test_calibration(spark):
    documents = fixtures.quoted(spark)
    spans = {(r.doc_id, dict(fixtures.QUOTED)[r.doc_id][r.start : r.end]) for r in calibrate.attributed_quotes(documents).collect()}
    assert spans == {(-1, '"This is really a robust, seamless tapestry."')}
    before = scan.line_findings(documents)
    after = calibrate.calibrated(before, documents).collect()
    hard = {d: sum(r.tier != "LOW" for r in after if r.doc_id == d) for d in (-1, -2, -3)}
    assert len(after) == before.count() and hard[-1] == 0 and hard[-2] and hard[-3]


def plain_band(n: list[int], band: int) -> tuple[int, int]:
    runs = [(j - i, -i) for i in range(len(n)) for j in range(i + 1, len(n) + 1) if max(n[i:j]) - min(n[i:j]) <= band]
    best = max(runs, default=(0, 0))
    return best[0], -best[1]


def test_band_runs_match_brute_force(spark):
    rng = random.Random(2)
    lengths = [[rng.randint(1, 25) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    texts = [" ".join("a " * (k - 1) + "a." for k in row) for row in lengths]
    found = {r.doc_id: (r.run, r.first) for r in series.band_runs(docs(spark, *texts, None)).collect()}
    assert found == {i: plain_band(row, series.RHYTHM_BAND) for i, row in enumerate([*lengths, []])}


def test_stretches_and_abstract_runs(spark):
    dull = "it is so that one may think about what things could be like when they are as they were before all of this."
    text = "\n\n".join([dull, "Short one.", dull, dull, "Then I left.", dull, "They met Ann " + dull, dull])
    found = series.author_stretches(docs(spark, text, None, ""), 30).collect()
    count = len(re.findall(r"\w+", dull))
    assert sorted((r.line_start, r.line_end, r.words) for r in found) == [(1, 7, 3 * count + 2), (11, 15, 3 * count + 3)]
    runs = series.abstract_runs(docs(spark, text)).collect()
    assert [(r.paragraphs, r.line_start, r.line_end) for r in runs] == [(4, 1, 11)]


def test_scaffold(spark):
    para = "It works well here. According to Ann it does. This does not prove much. It does not show more."
    frame = docs(spark, "\n\n".join([para] * 5), "\n\n".join([para, "It is. It was."]), para + " I saw it?", None)
    assert [r.seq for r in series.moves(frame).where("doc_id = 2").collect()] == [["claim", "source", "limit", "first-person"]]
    assert [(r.doc_id, r.paragraphs, r.scaffold) for r in series.scaffold_share(frame).collect()] == [(0, 5, 5)]
    assert {(r.sequence, r.docs) for r in series.shared_sequences(frame).collect()} == {("claim source limit", 3)}


def test_bootstrap_interval(spark):
    rows = [(i, int(i % 5 == 0), "ab"[i % 2]) for i in range(2000)] + [(9999, None, "a")]
    frame = spark.createDataFrame(rows, "id long, hit int, grp string")
    one = evaluate.bootstrap_rate(frame, "id", "hit").first()
    spread = 1.96 * (0.2 * 0.8 / 2000) ** 0.5
    assert one.n == 2000 and one.rate == 0.2 and abs(one.low - 0.2 + spread) < 0.006 and abs(one.high - 0.2 - spread) < 0.006
    again = evaluate.bootstrap_rate(frame.repartition(7), "id", "hit", "grp").collect()
    assert {r.grp: r.n for r in again} == {"a": 1000, "b": 1000} and evaluate.bootstrap_rate(frame, "id", "hit").first() == one


def test_pair_flips(spark):
    a = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (5, 1)], "id long, v int")
    b = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "id long, v int")
    assert evaluate.pair_flips(a, b, "id", "v").first().asDict() == {"pairs": 4, "gained": 2, "lost": 1, "kept": 1}


def test_values(spark):
    texts = ["é", "é", '{"b": 1, "a": [1, "é"]}', "no json", None, ""]
    v = F.col("text")
    found = docs(spark, *texts).select("*", values.normalised(v).alias("nfc"), values.canonical_json(v).alias("json"), values.blake2b(v).alias("b2"), values.commitment(F.lit("00ff"), v).alias("c"), values.token(v, F.lit("k")).alias("t"), values.ratio(v, F.lit("no jazz")).alias("r")).orderBy("doc_id").collect()
    assert [r.nfc for r in found] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert [r.json for r in found] == [None, None, '{"a":[1,"é"],"b":1}', None, None, None]
    for r, t in zip(found, texts, strict=True):
        if t is not None:
            assert r.b2 == hashlib.blake2b(t.encode(), digest_size=8).hexdigest() and r.r == difflib.SequenceMatcher(None, t, "no jazz", False).ratio()
            assert r.c == "sha256:" + hashlib.sha256(b"\x00\xff" + t.encode()).hexdigest()
            assert r.t == base64.urlsafe_b64encode(t.encode()).decode().rstrip("=") + "." + hashlib.sha256(f"k\n{t}".encode()).hexdigest()
        else:
            assert r.b2 is None and r.c is None and r.r is None


def test_budget(spark):
    found = scan.line_findings(fixtures.rule_lines(spark))
    assert sinks.within_budget(found, 0).count() == 0 and sinks.within_budget(found, 1 << 30).count() == found.count()
    some = sinks.within_budget(found, 400)
    assert 0 < some.count() < found.count() and set(some.columns) == set(found.columns)
