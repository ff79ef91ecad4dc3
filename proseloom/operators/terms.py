"""Terminology: banned terms and preferred ones, as generated rules over prose lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import lines as L


@dataclass(frozen=True)
class Term:
    """A phrase that is flagged: banned, or (with ``use``) another one is preferred."""

    phrase: str
    use: str | None = None
    tier: str | None = None
    match_case: bool = False
    reason: str = ""

    @property
    def rule_id(self) -> str:
        kind, head = ("preferred", self.use) if self.use else ("banned", self.phrase)
        return f"terminology/{kind}/" + (re.sub(r"[^a-z0-9]+", "-", head.lower()).strip("-")[:48] or "term")

    @property
    def severity(self) -> str:
        return self.tier or ("MEDIUM" if self.use else "HIGH")

    @property
    def pattern(self) -> str:
        """The whole phrase with any white space between its words; hyphens count as word characters."""
        words = r"\s+".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in self.phrase.split())
        return ("(?U)" if self.match_case else "(?iU)") + rf"(?<![\w-]){words}(?![\w-])"


def validated(terms: list[Term], allowed: tuple[str, ...] = ()) -> list[Term]:
    """The terms; an error for an empty phrase, an unknown tier or a phrase that is both flagged and allowed."""
    for t in terms:
        if not t.phrase.strip() or t.severity not in ("HIGH", "MEDIUM", "LOW"):
            raise ValueError(f"malformed term {t!r}")
    if clash := sorted({t.phrase.lower() for t in terms} & {a.lower() for a in allowed}):
        raise ValueError(f"{clash} are both flagged and allowed")
    return terms


def findings(documents: DataFrame, terms: list[Term], column: str = "text") -> DataFrame:
    """``doc_id, line, start, end, tier, category, label, match, rule_id``: every place of every term in prose lines."""
    if not validated(terms):
        raise ValueError("no terms")
    # one search for all terms first, in any case from the first one on that ignores it: few lines hold one
    lines = L.prose(documents, column).where(F.col("masked").rlike("|".join(t.pattern for t in terms)))
    label = lambda t: (f"write '{t.use}' for '{t.phrase}'" if t.use else f"'{t.phrase}' is banned") + (f" ({t.reason})" if t.reason else "")
    of = lambda t: F.transform(
        text.all_matches(F.col("masked"), t.pattern),
        lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"), F.lit(t.severity).alias("tier"), F.lit(label(t)).alias("label"), m["value"].alias("match"), F.lit(t.rule_id).alias("rule_id")),
    )
    rows = lines.select("doc_id", "line", "start", F.explode(F.concat(*map(of, terms))).alias("f"))
    return rows.select("doc_id", "line", (F.col("start") + F.col("f.s")).alias("start"), (F.col("start") + F.col("f.e")).alias("end"), "f.tier", F.lit("terminology").alias("category"), "f.label", "f.match", "f.rule_id")
