"""Personal data: base spans by pattern, and terms that give protected entities away (native: DataFrame functions only).

Every base span's text is a protected entity. A term is near an entity if it stands on the
entity's line and no other entity stands between them. How much a term reveals is estimated
from co-occurrence over all documents: of the n(t) documents that hold term t, n(c, t) hold it
near entity c. With n documents and n(c) distinct texts that hold c, the part of c's information
content log(n / n(c)) that t discloses is their pointwise mutual information's share of it,
1 + log(n(c, t) / n(t)) / log(n / n(c)): 1 if t occurs with c only. The share n(c, t) / n(t) is
taken at its lower bound (Wilson's, one deviation, with distinct texts as the support, so that
copies prove nothing). A term gives c away if that bound is at least ``MAJORITY`` and the part
that it discloses at least ``generalise``; it is then sanitised in every text that holds it,
with or without base spans.

A disclosing term is generalised to its class: its shape and the kind of the entity that it
discloses most. A generalisation must not give the entity away in its turn: of all texts in
which a class would stand near an entity, the part that are one entity's is judged in the same
way, and where the class discloses at least ``remove``, the term is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm._tables import texts, written

#: A quantifier that never gives back is used where giving back can't help, and a match starts at
#: the start of a run of its characters or where the last match ended: the matches are those of
#: the plain pattern, in time linear in the text.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{N}]+"
#: Part of an entity's information that a class must disclose for its terms to be removed, and a term to be sanitised; least share of a term's documents; normal deviations of the bounds.
REMOVE, GENERALISE, MAJORITY, DEVIATIONS = 0.8, 0.7, 0.4, 1.0
#: Values of one step of a running sum; code points of one piece of a text that is cut; bits of a filter.
_STEP, _PIECE, _BITS = 128, 1024, 1 << 24
_NONE = "array<struct<start:bigint,end:bigint,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(digits, lambda d, i: F.when(d == "", 0).otherwise(F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda span: _valid(kind, span["value"])


def _let(value: Column, then) -> Column:
    """What ``then`` makes of the value, which is worked out once."""
    return F.transform(F.array(value), then)[0]


def _before(values: Column, least, merge) -> Column:
    """For each of the array's values (longs) what ``merge`` makes of all before it, from ``least`` on: in steps of _STEP values, so that long arrays take no quadratic time."""
    start = F.lit(least).cast("long")

    def of(values: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")), lambda k: F.slice(values, k * _STEP + 1, F.lit(_STEP)))
        return _let(steps, lambda s: _let(F.transform(s, lambda x: F.aggregate(x, start, merge)), lambda merged: F.flatten(F.transform(s, inside(merged)))))

    def inside(merged: Column):
        def one(step: Column, k: Column) -> Column:
            return _let(F.aggregate(F.slice(merged, F.lit(1), k), start, merge), lambda base: F.transform(step, lambda _, i: F.aggregate(F.slice(step, F.lit(1), i), base, merge)))

        return one

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


def _matches(text: Column, pattern: Column, more) -> Column:
    """All matches as an array of structs ``start, end, value`` and what ``more`` makes of the value, in code points: between two matches lies one piece of the split text."""

    def placed(gaps: Column) -> Column:
        ends = _before(F.transform(gaps, lambda g: g["gap"] + g["size"]), 0, lambda a, x: a + x)
        return F.zip_with(gaps, ends, lambda g, e: F.struct((e + g["gap"]).alias("start"), (e + g["gap"] + g["size"]).alias("end"), g["value"].alias("value"), *more(g["value"])))

    def gaps(matches: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value")))

    return _let(_let(F.regexp_extract_all(text, pattern, F.lit(0)), gaps), placed)


def _located(text: Column, pattern: Column) -> Column:
    return _matches(text, pattern, lambda _: [])


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind its valid matches in the text, leftmost first and without overlaps."""
    return {
        kind: F.when(text.rlike(_NEEDS[kind]), F.filter(_located(text, F.lit(pattern)), _keeps(kind))).otherwise(F.array().cast(_NONE))
        for kind, pattern in PATTERNS.items()
    }


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _named(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def near(personal: DataFrame) -> DataFrame:
    """``key, copies, entity, kind, term``, distinct: what stands near what; personal: distinct texts (``key, text, copies``)."""
    lines = personal.select("key", "copies", F.explode(F.split("text", "\n")).alias("line"))
    # a barrier: each line's spans are found once
    spotted = lines.select("key", "copies", "line", F.explode(F.array(F.struct(*(v.alias(k) for k, v in base_spans(F.col("line")).items())))).alias("of"))
    every = F.array_sort(F.concat(*(F.transform(F.col(f"of.{k}"), _named(k)) for k in PATTERNS)))
    spans = spotted.where(F.size(F.concat(*(F.col(f"of.{k}") for k in PATTERNS))) > 0).select("key", "copies", "line", F.explode(F.array(every)).alias("spans"))
    # gaps: before the first entity, between each two, after the last; spans of several kinds may overlap
    reach = _before(F.transform("spans", lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))
    starts, ends = F.concat(reach, F.array(F.array_max(F.transform("spans", lambda s: s["end"])))), F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("line").cast("long")))
    gaps = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), F.greatest(b - a, F.lit(0)).alias("size")))
    cut = spans.select("key", "copies", "line", "spans", gaps.alias("gaps"))
    # a gap's terms are near the entity after it and the one before it
    one = cut.select("key", "copies", "line", "spans", F.posexplode("gaps").alias("k", "gap")).select(
        "key", "copies", F.filter(F.array(F.get("spans", F.col("k")), F.get("spans", F.col("k") - 1)), lambda s: s.isNotNull()).alias("beside"),
        _terms(F.substring(F.col("line"), (F.col("gap.at") + 1).cast("int"), F.col("gap.size").cast("int"))).alias("terms"),
    )
    pairs = one.select("key", "copies", "beside", F.explode("terms").alias("term")).select("key", "copies", "term", F.explode("beside").alias("one"))
    return pairs.select("key", "copies", F.col("one.value").alias("entity"), F.col("one.kind").alias("kind"), "term").distinct()


def _bound(held: Column, size: Column) -> Column:
    """Wilson's lower bound of a share that was held in so many cases."""
    square = DEVIATIONS**2
    spread = DEVIATIONS * F.sqrt(held * (1 - held) / size + square / (4 * size * size))
    return (held + square / (2 * size) - spread) / (1 + square / size)


def _part(share: Column, n: int, n_entity: Column) -> Column:
    """The part of an entity's information that a share discloses."""
    return 1 + F.log(share) / F.log(F.lit(float(n)) / n_entity)


def _shape(term: Column) -> Column:
    return F.when(term.rlike(r"^\p{N}+$"), "NUMBER").when(term.rlike(r"^\p{Lu}"), "NAME").otherwise("TERM")


def disclosures(pairs: DataFrame, personal: DataFrame, documents: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """``entity, term, n_term, disclosed, surely, of_class``: terms that give an entity near them away, the part of it that they disclose, its lower bound, and the part that the term's class (``kind``, ``shape``) discloses, at its bound.

    pairs: of ``near``; personal: distinct texts with their ``copies`` and base spans. Terms
    are `[\\p{L}\\p{N}]+`, as written; those inside an entity don't count, other numbers do.
    Copies of one text support a pair once.
    """
    # an entity may be of two kinds, as a card and a phone
    together = pairs.groupBy("key", "entity", "term").agg(F.min("copies").alias("copies"), F.max("kind").alias("kind")).groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_texts"), F.max("kind").alias("kind"))
    entities = F.array_distinct(F.flatten(F.array(*(F.transform(k, lambda s: s["value"]) for k in PATTERNS))))
    of_entity = personal.select(F.explode(entities).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    candidates = written(together.join(of_entity, "entity"), "entity-terms")
    n = documents.count()
    of_term = written(documents.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "term-counts")
    held = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))  # a base span may cut a word off from one that is a term elsewhere
    low = _bound(held, F.col("n_texts") / held)
    known = candidates.where(F.col("n_entity") < n).join(of_term, "term").select("*", low.alias("low"), _part(held, n, F.col("n_entity")).alias("disclosed"), _part(low, n, F.col("n_entity")).alias("surely"))
    told = written(known.where((F.col("low") >= MAJORITY) & (F.col("surely") >= generalise)).withColumn("shape", _shape(F.col("term"))), "disclosing-terms")
    # texts in which a class stands near an entity
    uses = told.groupBy("kind", "shape", "entity").agg(F.max("n_texts").alias("n_uses"), F.max("n_entity").alias("n_held"))
    of_class = uses.groupBy("kind", "shape").agg(F.sum("n_uses").alias("n_class"))
    class_low = _bound(F.col("n_uses") / F.col("n_class"), F.col("n_class"))
    classes = uses.join(of_class, ["kind", "shape"]).select("kind", "shape", "entity", _part(class_low, n, F.col("n_held")).alias("of_class"))
    return told.join(classes, ["kind", "shape", "entity"]).select("entity", "term", "n_term", "disclosed", "surely", "of_class")


def _apart(terms: Column, bases: Column) -> Column:
    """The term spans that overlap none of the base spans: all are sorted by their start, and each looks at how far bases before it reach and where the next one starts."""
    far = F.lit(1 << 62)

    def told(span: Column, kind: Column) -> Column:
        return F.struct(span["start"].alias("start"), kind.alias("rank"), span["end"].alias("end"), F.when(kind == 1, span).alias("term"))

    none = F.get(terms, F.lit(0))
    events = F.array_sort(F.concat(F.transform(bases, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("rank"), b["end"].alias("end"), F.when(F.lit(False), none).alias("term"))), F.transform(terms, lambda t: told(t, F.lit(1)))))

    def free(events: Column) -> Column:
        reach = _before(F.transform(events, lambda e: F.when(e["rank"] == 0, e["end"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
        ahead = F.reverse(_before(F.reverse(F.transform(events, lambda e: F.when(e["rank"] == 0, e["start"]).otherwise(far))), 1 << 62, lambda a, x: F.least(a, x)))
        seen = F.arrays_zip(events.alias("event"), reach.alias("reach"), ahead.alias("ahead"))
        return F.filter(seen, lambda z: (z["event"]["rank"] == 1) & (z["reach"] <= z["event"]["start"]) & (z["ahead"] >= z["event"]["end"]))

    return F.transform(_let(events, free), lambda z: z["event"]["term"])


def _bits(hashes: DataFrame) -> Column:
    """A filter over a frame of one column of hashes: a bit for each remainder, as one array of longs whose size is fixed."""
    name = hashes.columns[0]
    at = hashes.select(F.pmod(F.col(name), F.lit(_BITS)).alias("at"))
    known = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    every = hashes.sparkSession.range(0, _BITS // 64, 1, 4).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")).unionByName(known)
    whole = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("x")).select(F.col("x.bits")).scalar()


def _passes(bits: Column, value: Column) -> Column:
    """Whether the filter may hold the hash: true for all that it was made of, and for few others while it is sparse."""
    at = F.pmod(value, F.lit(_BITS))
    return F.get(bits, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0


_TOLD = "struct<disclosed:double,surely:double,kind:string,of_class:double>"
_SPANS = "array<struct<start:bigint,end:bigint,value:string,disclosed:double,surely:double,kind:string,of_class:double>>"


def _term_spans() -> Column:
    """The spans of the text's terms in ``told``, apart from base spans."""
    matched = _matches(F.col("text"), F.lit(TERM), lambda m: [F.element_at("told", m).alias("told")])
    chosen = F.transform(F.filter(matched, lambda s: s["told"].isNotNull()), lambda s: F.struct(s["start"], s["end"], s["value"], *(s["told"][c] for c in ("disclosed", "surely", "kind", "of_class")))).cast(_SPANS)
    return F.when(F.col("told").isNotNull(), _apart(chosen, F.concat(*PATTERNS))).otherwise(F.array().cast(_SPANS))


def spans(documents: DataFrame, generalise: float = GENERALISE, more: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id, text``, a column of base spans for each kind, and ``term`` (spans with ``disclosed``, ``surely``, the entity's ``kind`` and ``of_class``).

    Null texts count as empty. Term spans that overlap a base span are left out. Equal texts
    have equal spans, whatever their doc_id, which may be null or repeat. more: further columns
    to keep; their names must be none of these, nor ``key`` and ``told``.
    """
    read = texts(documents, *more)
    spotted = read.select("doc_id", "text", *more, *(v.alias(k) for k, v in base_spans(F.col("text")).items()))
    any_base = F.size(F.concat(*PATTERNS)) > 0
    found = written(spotted.where(any_base).withColumn("key", F.md5("text")), "personal-data")
    personal = written(found.groupBy("key").agg(F.count("*").alias("copies"), F.first("text").alias("text"), *(F.first(k).alias(k) for k in PATTERNS)), "personal-texts")
    pairs = written(near(personal), "near-terms")
    given = disclosures(pairs, personal, read, generalise)
    told = F.struct("disclosed", "surely", "kind", "of_class").cast(_TOLD).alias("told")
    own = written(pairs.join(given, ["entity", "term"]).groupBy("key", "term").agg(F.max(told).alias("told"), F.max("n_term").alias("n_term"), F.max("copies").alias("copies")), "told-terms")
    of_term = own.groupBy("term").agg(F.max("told").alias("told"), F.max("n_term").alias("n_term"), F.sum("copies").alias("n_near"))
    elsewhere = written(of_term.where("n_term > n_near").select("term", "told"), "terms-elsewhere")
    columns = ["doc_id", "text", *more, *PATTERNS]
    mapped = lambda rows: rows.groupBy("key", "term").agg(F.max("told").alias("told")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "told"))).alias("told"))  # noqa: E731  of one text
    rest = spotted.where(~any_base)
    own = own.select("key", "term", "told")
    if elsewhere.isEmpty():  # no text but those near an entity holds a term
        return found.join(mapped(own), "key", "left").select(*columns, _term_spans().alias("term")).unionByName(rest.select(*columns, F.array().cast(_SPANS).alias("term")))
    # a filter of fixed size first, so that few others of all terms and texts are shuffled
    may_tell = _passes(_bits(elsewhere.select(F.xxhash64("term"))), F.xxhash64("term"))
    held = read.select(F.md5("text").alias("key"), F.explode(_terms(F.col("text"))).alias("term")).where(may_tell).join(elsewhere, "term").select("key", "term", "told")
    every = written(mapped(own.unionByName(held)), "told-texts")
    may_hold = _passes(_bits(every.select(F.xxhash64("key"))), F.xxhash64(F.md5("text")))
    plain = lambda rows: rows.select("doc_id", "text", *more, *(v.alias(k) for k, v in base_spans(F.col("text")).items())).where(~any_base)
    joined = found.unionByName(plain(read.where(may_hold)).withColumn("key", F.md5("text"))).join(every.hint("merge"), "key", "left").select(*columns, _term_spans().alias("term"))
    return joined.unionByName(plain(read.where(~may_hold)).select(*columns, F.array().cast(_SPANS).alias("term")))


def _marked(by: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(by).alias("by"))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text's code points from start up to end; pieces: the text in stretches of _PIECE code points, so that no cut reads the text from its beginning."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
    many = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(many, (start - first * _PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def sanitised(documents: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, more: tuple[str, ...] = ()) -> DataFrame:
    """``spans()`` with ``clean``: the text with base spans replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``, disclosing terms removed or replaced by ``[NUMBER]``, ``[NAME]`` or ``[TERM]`` and the entity's kind, as ``[EMAIL NAME]``.

    Where base spans of two kinds overlap, the union of both is replaced, once, by the kind
    of the one that starts first.
    """
    found = spans(documents, generalise, more)
    word = lambda s: F.when(s["of_class"] >= remove, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit(" "), _shape(s["value"]), F.lit("]")))
    marks = F.array_sort(
        F.concat(
            *(F.transform(k, _marked(f"[{k.upper()}]")) for k in PATTERNS),
            F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), word(s).alias("by"))),
        )
    )
    state = found.select("*", F.explode(F.array(F.struct(marks.alias("marks"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces")))).alias("_s"))
    reach = _before(F.transform(F.col("_s.marks"), lambda m: m["end"]), 0, lambda a, x: F.greatest(a, x))
    put = F.zip_with(F.col("_s.marks"), reach, lambda m, at: F.when(m["start"] >= at, F.concat(_between(F.col("_s.pieces"), at, m["start"]), m["by"])).otherwise(F.lit("")))
    rest = _between(F.col("_s.pieces"), F.array_max(F.transform(F.col("_s.marks"), lambda m: m["end"])), F.length("text").cast("long"))
    return state.withColumn("clean", F.when(F.size("_s.marks") > 0, F.concat(F.array_join(put, ""), rest)).otherwise(F.col("text"))).drop("_s")
