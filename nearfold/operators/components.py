"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfold.plans.storage import scratch, written

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014). Edges are (hi, lo) with hi > lo.

    The least neighbours are written before they are joined: both sides of the join then come straight from a shuffle, and
    Spark can split the rows of a hub.
    """
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(written(least, "least"), "u")
    large = written(large.select(F.col("v").alias("hi"), F.col("m").alias("lo")), "large")  # a row per edge at most
    low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
    joined = large.join(low, "hi")
    return (
        joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionByName(low.select("hi", F.col("m").alias("lo")))
        .where("hi <> lo")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two lower neighbours, or a lower and a higher one. One aggregate, and no further round."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("up") < F.col("n"))))).first()[0]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node it reaches.

    Null ends are ignored; a self-loop gives a component of one. Work per round is
    joins and aggregates on the edge table only; the number of rounds grows with
    the logarithm of the longest chain. Raises after MAX_ROUNDS rounds.
    """
    with scratch(edges.sparkSession) as kept:
        return kept(_components(edges, a, b), "components")


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = written(pairs.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    loops = pairs.where("hi = lo").select(F.col("hi").alias("node"))
    now = pairs.where("hi <> lo")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        now = written(_star(now), "star")
    else:
        if not _settled(now):
            raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    found = found.unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
