"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.sources.tables import written


#: Nodes at most that count as hubs.
HUBS = 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges (``u, v``) with ``m`` of their u; least: ``u, m`` and ``degree``.

    Nodes with over a thousandth of all edges, at most a thousand, are joined by broadcast:
    their edges are not brought together.
    """
    hub = F.col("degree") > n / HUBS
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``, longs): root is the smallest node of its component.

    Each round links every node to the smallest node around it, so the number of rounds grows
    with the logarithm of the longest chain. Only a count and a checksum come to the driver.
    """
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), "least-neighbours")
        large = written(_with_least(both, low, 2 * state[0]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least-neighbours")
        small = _with_least(large, least, large.count())
        edges = written(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
