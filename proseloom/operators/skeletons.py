"""What the texts of a cluster share: a skeleton of words with slots, and what each text puts into the slots.

The skeleton is folded over the distinct texts of a cluster, in the order of their smallest ids:
what the skeleton so far and the next text have in common, in order, stays; where either has
more, a slot opens. A cluster's texts stream by in order, so a task holds one skeleton, which
only shrinks, and one text; copies are one text. The fillers are read in a second stream, in
which each cluster's skeleton comes before its texts, so a large cluster is never held, nor
joined with its skeleton text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import campaign

SLOT = "{}"
WORD = r"\S+"


def tokens(body: Column) -> Column:
    """Words of the normalised text."""
    return text.matches(campaign.normalised(F.coalesce(body, F.lit(""))), WORD)


def common(skeleton: list[str | None], words: list[str]) -> list[str | None]:
    """The skeleton's words that the text has in their order (by longest blocks), a slot (None) where either has more."""
    out: list[str | None] = []
    for kind, a, b, _, _ in SequenceMatcher(None, skeleton, words, autojunk=False).get_opcodes():
        out += skeleton[a:b] if kind == "equal" else [None]
    return [w for k, w in enumerate(out) if w is not None or not k or out[k - 1] is not None]


def fillers(literals: list[str], words: list[str]) -> list[str]:
    """What the text has before, between and after the literals: one more than there are literals, words joined by spaces; by longest blocks or, where these miss one, by each literal's first place."""
    blocks = SequenceMatcher(None, literals, words, autojunk=False).get_matching_blocks()
    at = [b + k for a, b, n in blocks for k in range(n)]
    if len(at) < len(literals):
        at, start = [], 0
        for w in literals:
            start = words.index(w, start) + 1
            at.append(start - 1)
    return [" ".join(words[a:b]) for a, b in zip([0, *(i + 1 for i in at)], [*at, len(words)], strict=True)]


def _members(items: DataFrame, clusters: DataFrame) -> DataFrame:
    return items.join(clusters.select("id", "cluster"), "id").select("cluster", "id", tokens(F.col("text")).alias("words"))


def skeletons(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster, skeleton`` (words and ``{}`` for slots, joined by spaces), ``literals`` and ``shared`` (their number). items: ``id, text``; clusters: ``id, cluster``."""
    kind = clusters.schema["cluster"].dataType.simpleString()
    distinct = _members(items, clusters).groupBy("cluster", "words").agg(F.min("id").alias("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, held, done = None, None, []
        for batch in batches:
            for own, words in zip(batch["cluster"].tolist(), batch["words"], strict=True):
                if held is None or own != cluster:
                    if held is not None:
                        done.append((cluster, held))
                    cluster, held = own, list(words)
                else:
                    held = common(held, list(words))
            if done:
                yield _told(done)
                done = []
        if held is not None:
            yield _told([(cluster, held)])

    ordered = distinct.where("cluster is not null").repartition("cluster").sortWithinPartitions("cluster", "id").select("cluster", "words")
    return ordered.mapInPandas(run, f"cluster {kind}, skeleton string, literals array<string>, shared long")


def _told(done: list[tuple]) -> pd.DataFrame:
    literals = [[w for w in s if w is not None] for _, s in done]
    return pd.DataFrame({"cluster": [c for c, _ in done], "skeleton": [" ".join(SLOT if w is None else w for w in s) for _, s in done], "literals": literals, "shared": [len(x) for x in literals]})


def filled(items: DataFrame, clusters: DataFrame, found: DataFrame) -> DataFrame:
    """``cluster, id, fillers``: for each text what stands before, between and after the literals of its cluster's skeleton; found: ``skeletons``. Literals and fillers, in turn, are the text's words."""
    kind, of = clusters.schema["cluster"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    heads = found.select("cluster", F.lit(None).cast(of).alias("id"), F.col("literals").alias("words"), F.lit(0).alias("rank"))
    rows = _members(items, clusters).where("cluster is not null").select("cluster", "id", "words", F.lit(1).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        literals: list[str] = []
        for batch in batches:
            out = []
            for cluster, one, words, rank in zip(*(batch[c].tolist() for c in ("cluster", "id", "words", "rank")), strict=True):
                if rank == 0:
                    literals = list(words)
                else:
                    out.append((cluster, int(one) if of in ("bigint", "int") else one, fillers(literals, list(words))))
            yield pd.DataFrame(out, columns=["cluster", "id", "fillers"])

    ordered = heads.unionByName(rows).repartition("cluster").sortWithinPartitions("cluster", "rank", "id")
    return ordered.mapInPandas(run, f"cluster {kind}, id {of}, fillers array<string>")


def rebuilt(found: DataFrame, fills: DataFrame) -> DataFrame:
    """``cluster, id, words``: the words of each text, from its cluster's literals and its own fillers."""
    both = fills.join(found.select("cluster", "literals"), "cluster")
    parts = F.zip_with("fillers", F.concat("literals", F.array(F.lit(""))), lambda f, w: F.array(f, w))
    return both.select("cluster", "id", F.array_join(F.filter(F.flatten(parts), lambda p: p != ""), " ").alias("words"))


def persona_groups(bios: DataFrame, threshold: float = campaign.FRAME_THRESHOLD) -> DataFrame:
    """``cluster, id, size, kind, skeleton, shared, fillers``: bios on one frame, their fillers masked before they are compared. bios: ``id, text, platform``."""
    framed = campaign.personas(bios).select("id", F.col("frame").alias("text"))
    grouped = campaign.clusters(framed, threshold)
    found = skeletons(framed, grouped)
    members = filled(framed, grouped, found)
    return grouped.join(members, ["cluster", "id"]).join(found, "cluster").select("cluster", "id", "size", "kind", "skeleton", "shared", "fillers")
