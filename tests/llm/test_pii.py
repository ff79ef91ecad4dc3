from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from proseloom.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> dict:
    return {k: [(m.start(), m.end()) for m in p.finditer(text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "b.", "@", ".", "1", "2", "55", "+", "-", " ", "%", "_", "é", "\U0001f600", "\n", "255", "0", "00", "4111111111111111", "(", ")", "x@y.z", "+1 (377) 555-0271", "10.0.0.1", "4111-1111-1111-1111"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(4000)] + [(-1, None), (-2, "1" * 50_000), (-3, "a." * 30_000), (-4, "x@" + "b." * 20_000 + "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = frame.select("doc_id", "text", *(v.alias(k) for k, v in pii.base_spans(F.coalesce("text", F.lit(""))).items())).collect()
    for r in found:
        assert {k: [(s.start, s.end) for s in r[k]] for k in PATTERNS} == brute(r.text), r.doc_id


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"Call Zimbalista about it at zim@corp.example.org please\nnumber {i} of the week") for i in range(6)]
    rows += [(100 + i, "please call about it, number of the week") for i in range(30)]
    rows += [(200, "Zimbalista is on stage tonight"), (201, None), (202, "")]
    documents = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, term string")
    found = {r.doc_id: r for r in pii.sanitised(documents, remove=0.99, generalise=0.7).collect()}
    assert len(found) == len(rows)
    assert all("Zimbalista" not in found[i].clean and "zim@" not in found[i].clean and "[EMAIL]" in found[i].clean for i in range(6))
    assert "[EMAIL NAME]" in found[0].clean and "please" in found[0].clean
    assert found[200].clean == "[EMAIL NAME] is on stage tonight" and not found[100].term
    assert found[201].clean == "" and found[202].clean == ""
    assert all(r.text[s.start : s.end] == s.value for r in found.values() for k in (*pii.PATTERNS, "term") for s in r[k])


def test_terms_of_an_entity_held_once(spark):
    rows = [(1, "Ask Quorvath at zim@corp.example.org about it"), (None, "Write to Ulmendra, dun@corp.example.org, about it")]
    rows += [(i, f"ask or write to them about it, at the number {i} Common") for i in range(2, 40)]
    rows += [(100 + i, "Copies of Belwick at bel@corp.example.org, please") for i in range(5)]
    found = {r.doc_id: r for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    assert "[EMAIL NAME] at [EMAIL] about it" in found[1].clean and "[EMAIL NAME], [EMAIL]" in found[None].clean
    # copies are one text: thin support, so the name is generalised and not removed
    assert "Belwick" not in found[100].clean and "[EMAIL NAME]" in found[100].clean
    assert "Common" in found[5].clean


def test_a_term_is_sanitised_in_texts_without_personal_data(spark):
    rows = [(i, f"the owner quorvath writes to ann@corp.example.org about {i}") for i in range(9)] + [(9, "quorvath lives in the old mill")]
    rows += [(10 + i, f"the owner of mill {i} writes to nobody about it") for i in range(30)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.sanitised(documents, remove=2.0).collect()}
    assert len(found) == len(rows)
    assert found[9].clean == "[EMAIL TERM] lives in the old mill" and not found[9].email
    assert all("quorvath" not in r.clean for r in found.values())
    assert all(found[i].clean == rows[i][1] for i in range(10, 40))
    # a term of one text near an entity and of others proves nothing about those
    rows = [(0, "ask belwick at bel@corp.example.org"), (1, "belwick rang"), (2, "nobody rang")] + [(3 + i, f"plain {i}") for i in range(60)]
    found = {r.doc_id: r.clean for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == "belwick rang" and "belwick" in found[0]


def test_terms_are_removed_where_their_class_gives_the_entity_away(spark):
    plain = [(1000 + i, f"they wrote from there, {i}") for i in range(2000)]
    one = [(i, f"Belwick wrote from bel@corp.example.org\nto {i}") for i in range(60)]
    found = pii.sanitised(spark.createDataFrame(one + plain, "doc_id long, text string")).where("doc_id < 60").collect()
    assert len(found) == 60 and all(r.clean.startswith(" wrote from [EMAIL]") for r in found)
    # names of many entities share a class, which tells none of them
    many = [(i, f"{chr(65 + i)}elwick wrote from p{i}@corp.example.org\nto {i}") for i in range(20)]
    found = pii.sanitised(spark.createDataFrame(many + plain, "doc_id long, text string")).where("doc_id < 60").collect()
    assert len(found) == 20 and all(r.clean.startswith("[EMAIL NAME] wrote from [EMAIL]") for r in found)


def brute_terms(texts: list[str], generalise: float) -> list[list[tuple]]:
    """Term spans of each text, by plain loops over texts, lines and entities."""
    term = re.compile(r"[^\W_]+")
    pairs: dict[str, set] = {}
    bases = [sorted((a, b, t[a:b]) for spans in brute(t).values() for a, b in spans) for t in texts]
    for t in set(texts):
        own = set()
        for line in t.split("\n"):
            spans = sorted((a, b, k) for k, v in brute(line).items() for a, b in v)
            at, edges = 0, []
            for a, b, _ in spans:
                edges.append((at, a))
                at = max(at, b)
            edges.append((at, len(line)))
            for k, (a, b) in enumerate(edges if spans else []):
                for x in spans[max(k - 1, 0) : k + 1]:
                    own |= {(line[x[0] : x[1]], w) for w in term.findall(line[a : max(a, b)])}
        pairs[t] = own
    n, both, distinct, of_entity, of_term = len(texts), {}, {}, {}, {}
    for t, base in zip(texts, bases, strict=True):
        for p in pairs[t]:
            both[p] = both.get(p, 0) + 1
            distinct.setdefault(p, set()).add(t)
        for c in {v for _, _, v in base}:
            of_entity.setdefault(c, set()).add(t)
        for w in set(term.findall(t)):
            of_term[w] = of_term.get(w, 0) + 1

    def bound(held: float, size: float) -> float:
        return (held + 1 / (2 * size) - math.sqrt(held * (1 - held) / size + 1 / (4 * size * size))) / (1 + 1 / size)

    told = set()
    for (c, w), k in both.items():
        if len(of_entity[c]) < n and w in of_term:
            held = min(1, k / of_term[w])
            low = bound(held, len(distinct[c, w]) / held)
            if low >= 0.4 - 1e-12 and 1 + math.log(low) / math.log(n / len(of_entity[c])) >= generalise - 1e-12:
                told.add((c, w))
    out = []
    for t, base in zip(texts, bases, strict=True):
        mine = {w for _, w in told}
        out.append([(m.start(), m.end()) for m in term.finditer(t) if m[0] in mine and not any(a < m.end() and m.start() < b for a, b, _ in base)])
    return out


def test_disclosing_terms_match_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)] + ["2024", "77", "Anna", "Bert", "größe"]
    entities = ["a@b.example", "c@d.example", "10.0.0.1", "+1 (377) 555-0271", "4111-1111-1111-1111", "5500000000000004"]
    texts = []
    for _ in range(150):
        lines = [" ".join(rng.choice(entities) if rng.random() < 0.12 else rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 4))]
        texts.append("\n".join(lines))
    texts += texts[:10]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for generalise in (0.8, 0.3, 0.7):
        want = brute_terms(texts, generalise)
        found = {r.doc_id: [(s.start, s.end) for s in r.term] for r in pii.spans(frame, generalise).collect()}
        assert [found[i] for i in range(len(texts))] == want
        assert any(want)


def test_a_line_of_many_entities_and_terms_is_cut_in_time(spark):
    import time

    line = " ".join(f"word{i} name{i}@mail{i}.example.com" for i in range(5_000))
    frame = spark.createDataFrame([(1, line), (2, line.replace(" ", "\n"))] + [(i, f"plain {i}") for i in range(3, 60)], "doc_id long, text string")
    begin = time.time()
    found = {r.doc_id: r.clean for r in pii.sanitised(frame).where("doc_id < 3").collect()}
    assert time.time() - begin < 60
    assert found[1].count("[EMAIL]") == found[2].count("[EMAIL]") == 5_000 and "@" not in found[1] + found[2]


def test_empty_and_repeated(documents, empty):
    assert pii.spans(empty).count() == 0
    assert pii.spans(documents).count() == documents.count()
