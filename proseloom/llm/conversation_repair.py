"""Repair of conversations at least cost: the turns that must change for roles to alternate as they should.

Roles, by their initials, should read ``(s?(ua)+)?``: perhaps a system turn, then pairs of user and
assistant. Turns can be kept (K, free), given the other role (R, cost 1), deleted (D, 2; the only
choice for blank and repeated turns) and inserted (I, 5, with an empty text); a truncated turn that
stays costs 5 more. Four states of the grammar are enough: nothing yet, after a system turn, after
a user's, after an assistant's; the first and the last accept.

The search is by layers of cost, as approximate matching with bitsets is (Wu and Manber). Every
turn has a bitset for each cost: the states from which the rest can be completed for exactly that.
Layer k of a turn comes from layers k, k-1, k-2, k-5 and k-6 of the turn after it, and an insertion
leads from layer k-5 of a turn to its layer k. All layers of a turn are fields of one number, so a
shift moves a whole set of layers at once. Costs of two states of one turn differ by 12 at most
(two insertions reach any state that matters, and a state after an assistant's turn can do all that
others can but for deleting a system turn), so sixteen layers from a turn's cheapest on hold all
that an optimum can pass. The first layer of the first turn with the state "nothing yet" gives the
cost; following the bits from there, with the least letter at each step, gives the least audit.
Given a state, only one of user and assistant can follow, so the audit determines the result.

Faults and layers need no texts: their pass shuffles a digest for each turn. It holds nine bytes
for each turn of one conversation, of the order of the audit itself. Texts are shuffled once, sorted
after the audit of their conversation, and read as a stream, so no conversation's texts are held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a given or inserted turn, and its role.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Layers of a turn, and every fourth bit of a word of so many layers with room for shifts.
LAYERS = 16
EACH = int("1" * 2 * LAYERS, 16)
WORD = (1 << 4 * LAYERS) - 1

PLAN = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"


def _stepped(state: int, initial: int) -> int:
    """The state after a kept turn of an initial's number (s, u, a, other); -1 if the grammar has none."""
    return {(NONE, 0): SYSTEM, (USER, 2): ASSISTANT}.get((state, initial), USER if initial == 1 and state != USER else -1)


def _before(layers: int, initial: int) -> int:
    """The states, layer by layer, from which a turn of this initial leads into the given ones."""
    if initial == 0:
        return (layers >> SYSTEM) & EACH
    if initial == 1:
        to = (layers >> USER) & EACH
        return to | to << SYSTEM | to << ASSISTANT
    return ((layers >> ASSISTANT) & EACH) << USER if initial == 2 else 0


def plan(codes: bytes) -> tuple[int, str]:
    """Least cost and least audit of a conversation. A code is a turn's initial (0 to 3: s, u, a, other) and its fault (0, 4, 8, 12: none, blank, duplicate, truncated)."""
    words, bases = array("Q"), array("q")

    def push(layers: int, base: int) -> None:
        for _ in range(2):  # two insertions reach every state that they can
            layers |= (_before(layers, 1) | _before(layers, 2)) << 4 * INSERT
        while not layers & 15:
            layers, base = layers >> 4, base + 1
        words.append(layers & WORD)
        bases.append(base)

    push(1 << NONE | 1 << ASSISTANT, 0)
    for code in reversed(codes):
        rest, initial, fault = words[-1], code & 3, code >> 2
        layers = rest << 4 * DELETE
        if fault in (0, 3):
            stays = _before(rest, initial) | (_before(rest, 1) | _before(rest, 2)) << 4 * REROLE
            layers |= stays << 4 * TRUNCATED if fault == 3 else stays
        push(layers, bases[-1])

    n = len(codes)

    def can(turn: int, state: int, cost: int) -> bool:
        layer = cost - bases[n - turn]
        return state >= 0 and 0 <= layer < LAYERS and bool(words[n - turn] >> (4 * layer + state) & 1)

    total = next(c for c in range(bases[n], bases[n] + LAYERS) if can(0, NONE, c))
    turn, state, left, audit = 0, NONE, total, []
    while turn < n or left or state not in (NONE, ASSISTANT):
        code = codes[turn] if turn < n else 4
        stays = TRUNCATED if code >> 2 == 3 else 0
        other = FOLLOWS[state]
        choices = [("D", turn + 1, state, DELETE)] if turn < n else []
        choices.append(("I", turn, other, INSERT))
        if code >> 2 in (0, 3):
            choices += [("K", turn + 1, _stepped(state, code & 3), KEEP + stays), ("R", turn + 1, other, REROLE + stays)]
        letter, turn, state, paid = next(c for c in choices if can(c[1], c[2], left - c[3]))
        left -= paid
        audit.append(letter)
    return total, "".join(audit)


def _key(row) -> tuple:
    """Order within a conversation: by turn, nulls first; of one turn by role, then by a digest of the text."""
    return (F.col("conv_id").asc_nulls_first(), *row, F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"))


def _known(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space), digest of the text."""
    told = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return told.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``digest`` and ``fault`` (blank, duplicate, truncated or null) of each row.

    A row's first fault counts: blank (no character but white space), duplicate (a row before it
    has its role and text), truncated (its last such character is none of ``.!?``).
    """
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = _known(turns).select("conv_id", "turn", "role", "digest", F.when(text == "", "blank").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "truncated").alias("own"))
    group = ["conv_id", "turn", "role", "digest", "own"]
    counted = slim.groupBy(*group).agg(F.count("*").alias("n"))  # equal rows of one turn are one row until they are told apart below
    first = counted.where("own is distinct from 'blank'").groupBy(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest"))).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    found = counted.join(first, same, "left")
    before = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    each = found.select("conv_id", "turn", "role", "digest", "own", before.alias("again"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    return each.select("conv_id", "turn", "role", "digest", F.when(F.col("own") == "blank", "blank").when(F.col("again") | (F.col("k") > 1), "duplicate").otherwise(F.col("own")).alias("fault"))


def _code(role: Column, fault: Column) -> Column:
    start = F.substring(role, 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    return (initial + F.when(fault == "blank", 4).when(fault == "duplicate", 8).when(fault == "truncated", 12).otherwise(0)).cast("int")


#: Pairs of initials that may follow each other.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Open:
    """What is held of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.turns, self.distinct = conv_id, bytearray(), None, 0

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None:
            if self.turns is None or self.turns[1] != turn:
                self.distinct += 1
            self.turns = (turn if self.turns is None else self.turns[0], turn)

    def done(self) -> tuple:
        faults = [sum(c >> 2 == f for c in self.codes) for f in (1, 2, 3)]
        illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(self.codes, self.codes[1:], strict=False))
        gaps = 0 if self.turns is None else self.turns[1] - self.turns[0] + 1 - self.distinct
        return (self.conv_id, *faults, illegal, gaps, *plan(bytes(self.codes)))


def plans(turns: DataFrame) -> DataFrame:
    """For each conversation: ``conv_id``, counts of ``blank``, ``duplicate``, ``truncated`` and ``illegal`` (neighbours whose initials aren't su, ua or au) turns, ``gaps`` in their numbers, ``cost`` and ``audit``."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {PLAN}"
    names = ["conv_id", *(c.split()[0] for c in PLAN.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, done, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            kinds = [own, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            own = batch.column(0).type
            for conv_id, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        done.append(held.done())
                        size += len(held.codes)
                        if size > 1 << 20 or len(done) >= 10_000:
                            yield out()
                            done, size = [], 0
                    held = _Open(conv_id)
                held.add(turn, code)
        if held is not None:
            done.append(held.done())
            yield out()

    slim = faults(turns).repartition("conv_id").sortWithinPartitions(*_key(())).select("conv_id", "turn", _code(F.col("role"), F.col("fault")).alias("code"))
    return slim.mapInArrow(run, schema)


def _streams(turns: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, together in one partition."""
    told = plan_rows.columns[1:]
    rows = _known(turns)
    kinds = {f.name: f.dataType for f in (*rows.schema, *plan_rows.schema)}
    columns = [*rows.columns, *told]
    both = [f.select(*(F.col(c) if c in f.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns)) for f in (plan_rows, rows)]
    placed = both[0].unionByName(both[1]).repartition("conv_id").sortWithinPartitions(*_key((F.col("audit").isNull(),)))
    return placed.select("conv_id", "role", "text", *told)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each plan its row; then, for each turn of the result, None and the turn's role and text."""
    state, audit, at, last = NONE, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, FOLLOWS[state]
            yield None, ROLES[state], ""

    for batch in batches:
        told = batch.schema.names.index("audit")
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[told] is not None:
                state, audit, at, last = NONE, row[told], 0, len(row[told].rstrip("I"))
                yield row, None, None
                continue
            yield from inserted()
            letter, role, at = audit[at], row[1], at + 1
            if letter == "R":
                state = FOLLOWS[state]
                yield None, ROLES[state], row[2]
            elif letter == "K":
                state = _stepped(state, "sua".index(role[0]))
                yield None, role, row[2]
            if at == last:
                yield from inserted()


def rebuilt(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 0), ``role`` and ``text`` of every turn that is left or inserted."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, size, conv_id, place = None, [], 0, None, 0

        def first(batches):
            nonlocal own
            for batch in batches:
                own = batch.column(0).type
                yield batch

        def out() -> pa.RecordBatch:
            kinds = (own, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "place", "role", "text"])

        for head, role, text in _rebuilt(first(batches)):
            if head is not None:
                conv_id, place = head[0], 0
                continue
            rows.append((conv_id, place, role, text))
            place, size = place + 1, size + len(text)
            if size > 1 << 22 or len(rows) >= 10_000:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return _streams(turns, plans(turns)).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def repaired(turns: DataFrame) -> DataFrame:
    """For each conversation what ``plans`` gives and ``repaired_sha256``, of its repaired ``role:text`` lines joined by newlines.

    Rows of one turn are ordered by role, then by a digest of the text. A null role or text is one
    space; a role that begins with none of s, u and a, or is empty, can't be kept. Null turns come
    first and leave no gap. Rows with a null conv_id are one conversation. Other columns are not
    read; an empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split()[0] for c in PLAN.split(", ")), "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, size, head, digest, lines = None, [], 0, None, None, 0

        def first(batches):
            nonlocal own
            for batch in batches:
                own = batch.column(0).type
                yield batch

        def out() -> pa.RecordBatch:
            kinds = [own, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for found, role, text in _rebuilt(first(batches)):
            if found is None:
                digest.update(("\n" * (lines > 0) + role + ":" + text).encode())
                lines += 1
                continue
            if head is not None:
                done.append((head[0], *head[3:], digest.hexdigest()))
                size += len(head[-1])
                if size > 1 << 20 or len(done) >= 10_000:
                    yield out()
                    done, size = [], 0
            head, digest, lines = found, hashlib.sha256(), 0
        if head is not None:
            done.append((head[0], *head[3:], digest.hexdigest()))
            yield out()

    return _streams(turns, plans(turns)).mapInArrow(run, f"conv_id {kind}, {PLAN}, repaired_sha256 string")
