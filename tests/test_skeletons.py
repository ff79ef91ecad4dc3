"""Skeletons of clusters: planted templates, folds by a plain loop, and texts rebuilt from them."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from proseloom.operators import campaign, skeletons


def test_planted_templates_give_their_words_and_fillers(spark):
    names, goods = ["Ann", "Bob Lee", "Cy"], ["tea", "red boats", "salt"]
    rows = [(k, f"Hello {n}, we sell {g} every day!", 1) for k, (n, g) in enumerate(zip(names, goods, strict=True))] + [(10, "Hello Ann, we sell tea every day!", 1), (20, "alone here", 2)]
    items = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    clusters = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, cluster long")
    found = skeletons.skeletons(items, clusters)
    told = {r.cluster: (r.skeleton, r.shared) for r in found.collect()}
    assert told == {1: ("hello {} we sell {} every day!", 5), 2: ("alone here", 2)}
    fills = {r.id: r.fillers for r in skeletons.filled(items, clusters, found).collect()}
    assert fills == {0: ["", "ann,", "", "tea", "", ""], 1: ["", "bob lee,", "", "red boats", "", ""], 2: ["", "cy,", "", "salt", "", ""], 10: ["", "ann,", "", "tea", "", ""], 20: ["", "", ""]}


def test_folds_equal_a_plain_loop_and_rebuild_every_text(spark):
    rng = random.Random(5)
    words = "a b c d e f".split()
    rows = [(k, rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), "a b c d", "x a y b z c"]), rng.choice([1, 2, 3, None])) for k in range(70)] + [(90, None, 1), (91, "", 3)]
    items = spark.createDataFrame([r[:2] for r in rows], "id long, text string").repartition(3)
    clusters = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, cluster long")
    found = skeletons.skeletons(items, clusters)
    want = {}
    for c in (1, 2, 3):
        seen = []
        for _, t, own in rows:
            if own == c and (t or "").split() not in seen:
                seen.append((t or "").split())
        skeleton = list(seen[0])
        for t in seen[1:]:
            out = []
            for tag, i, j, _, _ in SequenceMatcher(None, skeleton, t, False).get_opcodes():
                out.extend(skeleton[i:j] if tag == "equal" else [None])
            skeleton = []
            for w in out:
                if w is not None or not skeleton or skeleton[-1] is not None:
                    skeleton.append(w)
        want[c] = " ".join("{}" if w is None else w for w in skeleton)
    assert {r.cluster: r.skeleton for r in found.collect()} == want
    fills = skeletons.filled(items, clusters, found)
    assert {r.id: r.words for r in skeletons.rebuilt(found, fills).collect()} == {k: " ".join((t or "").split()) for k, t, c in rows if c is not None}
    assert skeletons.skeletons(items.limit(0), clusters).collect() == []


def test_fillers_hold_where_longest_blocks_miss_a_literal():
    literals, words = ["a", "b", "c"], ["b", "c", "a", "x", "b", "y", "c"]
    got = skeletons.fillers(literals, words)
    assert len(got) == 4 and " ".join(p for f, w in zip(got, [*literals, ""], strict=True) for p in (f, w) if p) == " ".join(words)


def test_persona_groups_share_a_frame(spark):
    rows = [(k, f"{20 + k} years old. Passionate about {g}. Here for the memes and the long walks by the sea.", "x") for k, g in enumerate(["crypto", "trading", "tea"])]
    rows += [(9, "I fix old clocks in a small town and write about rivers", "x"), (10, None, "x")]
    found = skeletons.persona_groups(spark.createDataFrame(rows, "id long, text string, platform string")).collect()
    assert sorted(r.id for r in found) == [0, 1, 2] and len({r.cluster for r in found}) == 1
    assert all(r.size == 3 and "here for" in r.skeleton for r in found)


def test_a_large_cluster_streams_by(spark):
    n = 6000
    items = spark.range(n).select("id", F.concat(F.lit("we sell "), F.col("id").cast("string"), F.lit(" boats today")).alias("text"))
    clusters = spark.range(n).select("id", F.lit(7).alias("cluster"))
    (row,) = skeletons.skeletons(items, clusters).collect()
    assert row.skeleton == "we sell {} boats today"
    assert skeletons.filled(items, clusters, skeletons.skeletons(items, clusters)).where("fillers[2] = id").count() == n
    assert campaign.CLUSTER_THRESHOLD == 0.5
