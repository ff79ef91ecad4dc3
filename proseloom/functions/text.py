"""Text as columns: words, sentences, masks and located matches, all JVM-side.

Offsets are code points from 0, ends exclusive. ``(?U)`` gives ``\\w``, ``\\b``, ``\\s`` and
``\\d`` their Unicode meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word patterns of the core rules, the rule packs and the negation reader.
WORD = r"(?U)\b\w+\b"
PACK_WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
NEGATION_WORD = r"[A-Za-z0-9][A-Za-z0-9'’.-]*"

#: Markup that is masked before a line is read. Quantifiers that can't need to give back don't, so a long line stays linear.
INLINE_CODE = r"`[^`]*`"
URL = r"(?U)https?://\S+|(?:(?<![\w.-])|(?<=(?<![\w.-])[.-]{1,20}))(?=\w)[\w.-]++@[\w.-]+\.\w+\b"
TAG = r"<[^>]+>"
TEX = r"\\[a-zA-Z]+\*?\{?|[{}]"
#: What is masked, in this order.
MARKUP = (INLINE_CODE, URL, TAG, TEX)
#: Of each of these, literals one of which a match holds.
MARKUP_NEEDS = (("`",), ("://", "@"), ("<",), ("\\", "{", "}"))
QUOTED = '"[^"\\n]*"|“[^”\\n]*”|‘[^’\\n]*’'


def unified(text: Column) -> Column:
    """Line ends as ``\\n``, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    """How many matches, as a long."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    return matches(text, WORD)


def first_match(text: Column, pattern: str) -> Column:
    """The first match as ``struct<start, end, value>``, or null. A pattern must not match the empty string."""
    value = F.regexp_extract(text, pattern, 0)
    start = F.length(F.element_at(F.split(text, pattern, 2), 1)).cast("long")
    return F.when(text.rlike(pattern), F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once, however often the body or a lambda in it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(lengths: Column, block: int = 256) -> Column:
    """Before each element, the sum of those before it. Sums of blocks come first, so that a long array isn't copied for each element."""
    kind = "array<bigint>"

    def running(base: Column, values: Column) -> Column:
        grown = F.aggregate(values, F.array(base.cast("bigint")), lambda out, v: F.concat(out, F.array(F.element_at(out, -1) + v)))
        return F.slice(grown, 1, F.size(values))

    def whole(values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda k: F.slice(values, k * block + 1, block))
        return let(cut, lambda parts: F.flatten(F.zip_with(parts, running(F.lit(0), F.transform(parts, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda n, v: n + v))), lambda x, base: running(base, x))))

    return let(lengths.cast(kind), lambda values: F.when(F.size(values) > 0, whole(values)).otherwise(F.array().cast(kind)))


#: A code point that Unicode keeps for the inner use of programs: it marks both edges of each match while a text is cut.
_EDGE = "\ufdd0"


def cut(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """What lies between the matches and the matches, in turn, beginning and ending with the former; needs: literals without all of which the pattern is not tried.

    The pattern is searched once: a replacement marks the edges, at which the text is split.
    A text that holds the mark itself is searched twice instead.
    """
    marked = F.split(F.regexp_replace(text, pattern, f"{_EDGE}$0{_EDGE}"), _EDGE, -1)
    pairs = F.zip_with(F.split(text, pattern, -1), F.concat(matches(text, pattern), F.array(F.lit(""))), lambda p, m: F.array(p, m))
    whole = let(F.flatten(pairs), lambda x: F.slice(x, 1, F.size(x) - 1))
    found = F.when(text.contains(_EDGE), whole).otherwise(marked)
    return F.when(reduce(or_, (text.contains(x) for x in needs)), found).otherwise(F.array(text)) if needs else found


def pieces(text: Column, pattern: str) -> Column:
    """What lies between the matches, none of which is empty: a split that reads its pattern once, not for each text."""
    return F.when(text.contains(_EDGE), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _EDGE), _EDGE, -1))


def located(parts: Column) -> Column:
    """The matches of a text that was ``cut``, as an array of ``struct<start, end, value>``."""
    long = lambda x: F.length(x).cast("long")

    def placed(pairs: Column) -> Column:
        before = starts(F.transform(pairs, lambda p: p["gap"] + long(p["value"])))
        span = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + long(p["value"])).alias("end"), p["value"].alias("value"))
        return F.zip_with(pairs, before, span)

    def paired(x: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(x) - 1, F.lit(2)), lambda k: F.struct(long(F.element_at(x, k)).alias("gap"), F.element_at(x, k + 1).alias("value")))
        return let(pairs, placed)

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(parts, lambda x: F.when(F.size(x) > 1, paired(x)).otherwise(none))


def blank(parts: Column) -> Column:
    """The text that was ``cut``, with as many spaces for each match."""
    return F.array_join(F.transform(parts, lambda x, k: F.when(k % 2 == 1, F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "")


def all_matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost first, as an array of ``struct<start, end, value>``; a null text has none."""
    return located(cut(F.coalesce(text, F.lit("")), pattern))


_STRETCH = 1024


def stretches(text: Column) -> Column:
    """The text cut into stretches of 1024 code points, for ``between``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_STRETCH}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """What lies from start up to end in a text cut into ``stretches``, without a look at all that lies before."""
    first, last = F.floor(start / _STRETCH).cast("int"), F.floor((end - 1) / _STRETCH).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, (start - first * _STRETCH + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def spliced(text: Column, edits: Column) -> Column:
    """The text with what lies between each edit's ``start`` and ``end`` replaced by its ``new``; edits are sorted and apart.

    What stays is cut from stretches of 1024 code points and joined once, so time is linear in
    text and edits.
    """
    whole = F.length(text).cast("long")

    def made(edits: Column) -> Column:
        return let(stretches(text), lambda parts: F.array_join(F.flatten(pieces(edits, parts)), ""))

    def pieces(edits: Column, parts: Column) -> Column:
        begin = F.concat(F.array(F.lit(0).cast("long")), F.transform(edits, lambda e: e["end"]))
        gaps = F.zip_with(begin, F.concat(F.transform(edits, lambda e: e["start"]), F.array(whole)), lambda a, b: between(parts, a, b))
        return F.zip_with(gaps, F.concat(F.transform(edits, lambda e: e["new"]), F.array(F.lit(""))), lambda g, n: F.array(g, n))

    return F.when(F.size(edits) > 0, let(edits, made)).otherwise(text)


def phrase_matches(text: Column, phrases: list[str], hyphens: bool = False) -> Column:
    """Places of phrases, whole words in any case with any white space between them, leftmost and longest first, as ``struct<start, end, value>``; value: the phrase as listed.

    Runs of words of each listed length are looked up; marks between words are tokens of their
    own, so no run leads over one. hyphens: a hyphen belongs to a word.
    """
    token = r"[\w-]+|[^\w\s-]+" if hyphens else r"\w+|[^\w\s]+"
    listed = {" ".join(re.findall(token, p.lower())): p for p in phrases}
    sizes = sorted({len(k.split()) for k in listed}, reverse=True)
    names = F.create_map(*(F.lit(x) for pair in listed.items() for x in pair))
    kind = "array<struct<start:bigint,end:bigint,value:string>>"

    def runs(tokens: Column) -> Column:
        words = F.transform(tokens, lambda t: F.lower(t["value"]))
        return let(words, lambda w: looked_up(tokens, w))

    def looked_up(tokens: Column, words: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(*sorted({k.split()[0] for k in listed})))
        tried = lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice(words, i, n), " ").alias("key")))
        hits = F.filter(F.flatten(F.transform(first, tried)), lambda h: (h["i"] + h["n"] - 1 <= F.size(words)) & h["key"].isin(*listed))
        spans = F.transform(hits, lambda h: F.struct(F.element_at(tokens, h["i"])["start"].alias("start"), F.element_at(tokens, h["i"] + h["n"] - 1)["end"].alias("end"), F.element_at(names, h["key"]).alias("value")))
        return F.aggregate(spans, F.array().cast(kind), lambda out, h: F.when((F.size(out) == 0) | (h["start"] >= F.try_element_at(out, F.lit(-1))["end"]), F.concat(out, F.array(h))).otherwise(out))

    tokens = all_matches(text, f"(?U){token}")
    return let(tokens, lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(F.array().cast(kind)))


def blanked(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """The text with every match replaced by as many spaces, so that offsets stay valid. needs: literals without all of which the pattern is not tried."""
    made = let(cut(text, pattern), lambda x: F.when(F.size(x) > 1, blank(x)).otherwise(text))
    return F.when(reduce(or_, (text.contains(x) for x in needs)), made).otherwise(text) if needs else made


def without_quotes(text: Column) -> Column:
    return blanked(text, QUOTED)


def sentences(text: Column) -> Column:
    """Pieces between an end mark and the white space after it; blank ones are left out."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+", -1), lambda s: F.trim(s) != "")


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, as arrays. The tokens are worked out once, not for each run."""
    none = F.array().cast("array<array<string>>")

    def runs(ws: Column) -> Column:
        last = F.size(ws) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(ws, i, n))).otherwise(none)

    return let(tokens, runs)


def syllables(word: Column) -> Column:
    """Runs of vowels after a silent ending is dropped: 0 without a letter, else at least 1."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut = (
        F.when(w.rlike("[^aeiouy]le$"), w)
        .when(w.endswith("ed"), F.when(w.rlike("[td]ed$"), w).otherwise(F.regexp_replace(w, "ed$", "")))
        .when(w.endswith("es"), F.when(w.rlike("(?:[sxzcg]|ch|sh)es$"), w).otherwise(F.regexp_replace(w, "es$", "")))
        .when(w.endswith("e") & ~w.rlike("(?:ee|ye)$"), F.regexp_replace(w, "e$", ""))
        .otherwise(w)
    )
    vowels = F.greatest(F.lit(1).cast("long"), count(F.regexp_replace(cut, "^y", ""), "[aeiouy]+"))
    return F.when(w == "", F.lit(0).cast("long")).when(F.length(w) <= 3, F.lit(1).cast("long")).otherwise(vowels)
