from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, queue string, block string, node string, label string"


def corpus() -> list[tuple]:
    """Nulls, empties, a long text, copies, near copies, shared passages, repeated words; doc_ids in no order, one of them twice."""
    rng = random.Random(7)
    words = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(80), say(120).split()
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Only three words"), (5, say(3000)), (6, say(60)), (7, "für Größe " * 40), (8, "\U0001f600 mail a.b@c.example.com now"), (9, "so " * 200), (10, "so " * 120)]
    rows += [(20 + i, say(rng.randint(5, 90))) for i in range(60)]
    rows += [(100 + i, say(30) + " " + passage + "\n" + say(20)) for i in range(8)]
    rows += [(120 + i, " ".join(base)) for i in range(6)]
    for i in range(12):
        near = list(base)
        near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((140 + i, " ".join(near)))
    rows.append((25, say(70)))
    rng.shuffle(rows)
    return [(i, t, "en", rng.choice([None, "a", "a", "a", "b", "c"]), len(t or ""), "x", "y", "z", "w") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def unique(spark, rows):
    """The corpus without the repeated doc_id."""
    return spark.createDataFrame(list({r[0]: r for r in rows}.values()), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
