"""The writing rules, read from ``rules.tsv``, and word lists of the document measures."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources


@dataclass(frozen=True)
class Rule:
    tier: str
    category: str
    label: str
    pattern: str

    @property
    def rule_id(self) -> str:
        slug = re.sub(r"[^a-z0-9]+", "-", self.label.lower()).strip("-")[:48]
        return f"{self.category}/{slug}" if slug else self.category

    @property
    def java(self) -> str:
        return "(?U)" + self.pattern

    @property
    def looks_around(self) -> bool:
        return any(mark in self.pattern for mark in ("(?!", "(?=", "(?<"))


@lru_cache
def rules(*tiers: str) -> tuple[Rule, ...]:
    """The rules of the tiers (HIGH, MEDIUM, LOW, FICTION, INJECTION), in their fixed order."""
    lines = resources.files(__package__).joinpath("rules.tsv").read_text("utf-8").splitlines()
    found = tuple(Rule(*line.split("\t")) for line in lines if line and not line.startswith("#"))
    return tuple(r for r in found if not tiers or r.tier in tiers)


# Categories to which an allowlist does not apply.
ALLOW_EXEMPT = ("antithesis", "corrective-negation", "substitution", "negative-parallel", "cadence")

# Frequent openers and grams' function words, which count for nothing by themselves.
OPENER_STOP = (
    "the a an it this that these those there in on for and but so to as we you i they he she its their our his her at of by with from or if when while "
    "then now here no one each every some most all both what how why"
).split()
NGRAM_STOP = (
    "the a an and or but of to in on for with as at by is are was were be been it its this that these those you we they i he she from into than then so "
    "if not no do does can will would your our their there here which"
).split()
PRONOUNS = "you we i they he she it".split()
STOP4 = (
    "that this what with from have were been will would could should there their them then than when which your some more most into over only also such "
    "each does here must very much many both even just like well back down upon onto whom cannot about because while"
).split()

# Patterns of the document measures.
FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^\s{0,3}#{1,6}\s"
BULLET = r"^\s*(?:[-*+]|\d+\.)\s"
BOLD = r"\*\*[^*\n]+\*\*|__[^_\n]+__"
RULE_LINE = r"^\s*-{3,}\s*$"
ADVERB = r"(?iU)\b\w{3,}ly\b"
PASSIVE = r"(?iU)\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+ed\b(?!\s+by\b)"
NOMINAL = r"(?iU)\b\w{4,}(?:tion|ment|ance|ence|ancy|ency)\b"
EXPLETIVE = r"(?iU)^(?:there (?:is|are|was|were)|it (?:is|was) (?:important|worth|crucial|essential|necessary))\b"
VAGUE_QUANTITY = r"(?iU)\b(?:various|numerous|a number of|several)\b"
HEDGE = r"(?iU)\b(?:may|might|could|can|perhaps|possibly|potentially|likely|probably|maybe|generally|typically|usually|often|somewhat|arguably|seemingly|presumably|conceivably)\b"
NEGATIVE = r"(?iU)\b(?:cannot|can ?not|can't|is ?n't|is not|are ?n't|are not|does ?n't|does not|do ?n't|do not|will not|won't|never|no longer|not)\b"
SOFT = (
    r"(?iU)\b(?:essential|significant(?:ly)?|enhance[sd]?|enhancing|accelerate[sd]?|deliver(?:s|ed|ing)?|ensure[sd]?|ensuring|crucial(?:ly)?|vital(?:ly)?|"
    r"optimi[sz]e[sd]?|streamlin(?:e[sd]?|ing)|effective(?:ly)?|efficient(?:ly)?|innovat(?:e|es|ed|ive|ion)|solutions?|impact(?:ful)?|meaningful|valuable|"
    r"powerful|comprehensive|thoughtful(?:ly)?|significantly|productivity|outcomes?|workflows?|capabilit(?:y|ies))\b"
)
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F0FF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{2190}-\x{21FF}]"
FRAGMENT = (
    r"(?iU)^\s*(?:(?:very|really|remarkably|genuinely|impressively|surprisingly)\s+)?(?:strong|solid|clean|elegant|powerful|robust|simple|clear|sound|smart|"
    r"impressive|remarkable|compelling|decent|great|excellent|fine|good|tight|slick|neat|thoughtful|careful|rigorous|brilliant|nice|classic|textbook)\s+"
    r"(?:foundations?|architecture|design|reasoning|logic|structure|framing|insight|distinction|approach|execution|progress|groundwork|footing|fundamentals?|"
    r"engineering|craftsmanship|integration|abstraction|premise|thesis|argument|analysis|coverage|separation|encapsulation|typing)[.!?](?=\s|$)"
)
ALLOW_LINE = r"(?i)writing-allow:\s*([^\n>%]+)"
