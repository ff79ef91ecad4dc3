"""States of lines are told inside the row, and guards look at beginnings of words."""

from __future__ import annotations

import re

from proseloom.functions import literals
from proseloom.operators import calibrate
from proseloom.operators import lines as L

TEXTS = [
    "---\na: b\n---\nText.\n```\ncode\n---\n```\nAfter `x`.", "---\nopen front\n```\n---\n```\n---\nlast", "--- \n ---\nx", "~~~\nnever closed\nx", "", None, "\n", "a\r\nb\rc\n\n", " ```\nin\n  ~~~ \nout", "x\n---\ny",
]


def test_states_without_an_exchange(spark):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    told = L.with_states(documents)
    asked = ("doc_id", "line", "start", "raw", "in_fence", "front")
    assert sorted(map(tuple, told.select(*asked).collect())) == sorted(map(tuple, L.states(L.lines(documents)).select(*asked).collect()))
    for frame in (L.prose(documents), calibrate.attributed_quotes(documents)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_document_stay_apart(spark):
    twice = spark.createDataFrame([(1, "```\nopen"), (1, "He said \"no\" to it all that day.\n\nShe wrote “yes” to him and to me.")], "doc_id long, text string")
    assert {r.raw for r in L.prose(twice).collect()} == set(twice.collect()[1].text.split("\n"))
    assert sorted((r.start, r.end) for r in calibrate.attributed_quotes(twice).collect()) == [(8, 12), (44, 49)]


def test_beginnings_of_words():
    assert literals.opened(r"(?iU)\b(?:Delve|tapestr(?:y|ies))\b") == {"delve", "tapestry", "tapestries"}
    assert literals.opened(r"\bthe\s+former\b") == {"former"} and literals.opened(r"^\s*(?:so |but )?what if") == {"so what if", "but what if", "what if"}
    assert literals.opened(r"x\s*foo") is None and literals.opened(r"\w+tion\b") is None and literals.opened(r"\b(?:un)?likely|other") is None
    assert literals.mark(r"(?U)\s\x{2013}\s") == {"–"} and literals.mark(r"[a-c]") is None and literals.mark(r"(?i)ab") is None
    for pattern, said in ((r"(?i)\bnot (?:only|just)\b", "It is Not Just"), (r"(?i)(?:^|\s)but why", "x But why"), (r"(?i)[.!?]\s+(?:and|so) that", "a. So that")):
        assert re.search(pattern, said) and (literals.opened(pattern) is None or any(re.search(rf"(?i)(?<!\w){re.escape(w)}", said) for w in literals.opened(pattern)))
