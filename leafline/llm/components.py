"""Connected components of an edge table by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm.spread import keep


def _stars(pairs: DataFrame) -> DataFrame:
    """Each u with the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _tidy(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with u > v."""
    return pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    ``edges`` has the columns u and v of any type with an order; nulls, loops and
    repeated edges are left out.  Every round writes the edges once to the
    checkpoint folder, and ends when they are stars; rounds grow with the
    logarithm of the longest path.  Stars keep a hub's edges as rows of many
    keys' groups; counts combine before the shuffle.
    """
    edges = keep(_tidy(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v")))
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _tidy(both.join(_stars(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = _stars(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = keep(_tidy(small))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
