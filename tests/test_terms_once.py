"""Terms are searched for together before each is placed."""

from __future__ import annotations

from proseloom.operators import terms


def test_terms_in_any_order_of_case(spark):
    asked = [terms.Term("Low"), terms.Term("Is", use="Are", match_case=True), terms.Term("c++")]
    documents = spark.createDataFrame([(1, "is LOW, Is low\nflow isis\nC++ and\nIs it"), (2, "nothing"), (3, None)], "doc_id long, text string")
    for order in (asked, asked[::-1]):
        found = terms.findings(documents, order)
        assert sorted((r.line, r.match) for r in found.collect()) == [(1, "Is"), (1, "LOW"), (1, "low"), (3, "C++"), (4, "Is")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
