"""Plans against a plain search over all edits, the query against a plain reading of its contract."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict
from zlib import crc32

from proseloom.llm import conversation_repair as repair
from proseloom.llm.queries import QUERIES, _damaged

FIRST = {"blank": 4, "duplicate": 8, "truncated": 12}


def cheapest(rows: list[tuple[str, str | None]]) -> tuple[int, str, list]:
    """Cost, audit and result of (initial, fault) rows: least (cost, audit) for every place and role sequence that matters, turn by turn."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def better(into: dict, state: str, found: tuple) -> None:
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def inserted(best: dict) -> dict:
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for r in "ua":
                    if r in allowed[state]:
                        better(best, r, (cost + 5, audit + "I", [*out, (r, None)]))
        return best

    for k, (initial, fault) in enumerate(rows):
        into: dict = {}
        for state, (cost, audit, out) in inserted(best).items():
            better(into, state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                stays = 5 * (fault == "truncated")
                if initial in allowed[state] and initial:
                    better(into, initial, (cost + stays, audit + "K", [*out, (initial, k)]))
                for r in "ua":
                    if r in allowed[state]:
                        better(into, r, (cost + stays + 1, audit + "R", [*out, (r, k)]))
        best = into
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def test_plans_equal_the_plain_search():
    kinds = list(itertools.product("suax", (None, "blank", "duplicate", "truncated")))
    code = lambda rows: bytes("suax".index(i) + FIRST.get(f, 0) for i, f in rows)
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n) if n < 3 else random.Random(1).sample(list(itertools.product(kinds, repeat=3)), 1500):
            assert repair.plan(code(rows)) == cheapest(rows)[:2], rows
    rng = random.Random(2)
    for _ in range(1500):
        weights = [rng.random() ** 3 for _ in kinds]
        rows = rng.choices(kinds, weights, k=rng.randint(4, 40))
        assert repair.plan(code(rows)) == cheapest(rows)[:2], rows


def test_audits_are_least_among_all_of_the_same_cost():
    """Every string of edits for short conversations."""
    allowed = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    for rows in itertools.product([("s", None), ("u", None), ("a", "truncated"), ("u", "blank")], repeat=3):
        found = []
        for size in range(3, 7):
            for letters in itertools.product("DIKR", repeat=size):
                if sum(c != "I" for c in letters) != 3:
                    continue
                cost, state, turn = 0, "", iter(rows)
                for c in letters:
                    initial, fault = next(turn) if c != "I" else ("", None)
                    cost += {"D": 2, "I": 5, "K": 0, "R": 1}[c] + (5 if fault == "truncated" and c != "D" else 0)
                    if c != "D":
                        to = initial if c == "K" else "a" if state == "u" else "u"
                        state = allowed[state].get(to) if fault != "blank" else None
                        if state is None:
                            break
                if state in ("", "a"):
                    found.append((cost, "".join(letters)))
        assert repair.plan(bytes("sua".index(i) + FIRST.get(f, 0) for i, f in rows)) == min(found)


def test_a_long_conversation_takes_linear_time():
    code = bytes([1, 2] * 100_000 + [13] * 1000 + [1] * 999)
    cost, audit = repair.plan(code)
    assert len(audit) >= len(code) and cost > 0


def read(rows: list[tuple]) -> dict:
    """Contract, row by row: (conv_id, turn, role, text), before any damage."""
    talks = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub(r"[.!?]", "", text)
        elif kind == 4:
            role = "user"
        talks[conv_id] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv_id, told in talks.items():
        told.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for turn, role, text in told:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault, turn))
        turns = [m[3] for m in marked if m[3] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, result = cheapest([(r[:1] if r[:1] in ("s", "u", "a") else "x", f) for r, _, f, _ in marked])
        names = {"u": "user", "a": "assistant"}
        rest = iter(audit.replace("D", ""))
        lines = []
        for initial, k in result:
            letter = next(rest)
            lines.append(f"{marked[k][0] if letter == 'K' else names[initial]}:{'' if k is None else marked[k][1]}")
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        count = lambda kind: sum(m[2] == kind for m in marked)  # noqa: E731, B023
        out[conv_id] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_query_equals_a_plain_reading_of_the_contract(spark):
    found = QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert found.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = read(rows)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    assert sum(w[5] > 0 for w in want.values()) > 20


def test_nulls_ties_other_roles_and_clashing_names(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n", "Yes.", "No", "Well!  \t", "für ", "a?b", "Yes.", "... "]
    roles = ["user", "assistant", "system", "tool", None, "", "usher", "User", "user", "assistant"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(60)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(9, None, "user", "Hello."), (9, None, "assistant", "Hi."), (9, None, "user", "Hello.")]
    rows += [(100 + k, t, r, x) for k in range(60) for t, (r, x) in enumerate([("system", "Be kind."), ("user", f"Is it {k}?"), ("assistant", "It is."), ("user", "Why?"), ("assistant", "So")][: rng.randint(1, 5)])]
    extra = "conv_id long, turn int, role string, text string, audit string, fault int, digest string, n int, place int, _conv_id int"
    turns = spark.createDataFrame([(*r, "q", 1, "w", 2, 3, 4) for r in rows], extra).repartition(3)
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    want = read(rows)
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    every = {r[0] for r in rows}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {c: want[c] if want[c][6] else nothing for c in every}
    assert None in found
    lines = defaultdict(list)
    for r in sorted(repair.rebuilt(_damaged(turns)).collect(), key=lambda r: (r.conv_id or -1, r.place)):
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in every} == {c: w[7] for c, w in found.items()}
    assert QUERIES["op12_conversation_repair"](spark, str(tmp_path)).count() == len(every)
    assert repair.repaired(turns.limit(0)).collect() == [] and repair.rebuilt(turns.limit(0)).collect() == []
