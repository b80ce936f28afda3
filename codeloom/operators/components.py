"""Distributed connected components (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.shared import materialize, remove_table
from codeloom.plans.skew import salted_lookup

MAX_ROUNDS = 60


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    """u -> m: the least of u and its neighbours in ``pairs`` (u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = salted_lookup(both.filter("v > u"), _min_neighbour(both), ["u"], F.col("v"), "inner")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _min_neighbour(down)
    linked = salted_lookup(down, least, ["u"], F.col("v"), "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a leaf straight to its least node."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected edge list with the least node it can reach.

    Returns ``node, component`` for the nodes that have an edge to another
    node; null ends and self-loops are ignored and an empty list gives an empty
    table. No round gathers a node's neighbours into one row: each is a
    partial-aggregated minimum and a salted join, and the edges of either half
    are written to the shared folder, so that lineage does not grow with the
    rounds and the second half, which reads its edges thrice, repeats nothing.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(MAX_ROUNDS):
        if _settled(current):
            break
        large = materialize(_large_star(current), "cc")
        after = materialize(_small_star(large), "cc")
        remove_table(current, large)
        current = after
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
