"""Connected components of a link table, by alternating star steps.

Each step is a grouped minimum and a join, and is written to the shared folder, so a lost
executor costs no earlier step. A node with very many links is pre-aggregated before the shuffle,
and the join back may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewatch.sources.tables import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links of a node to larger nodes move to the smallest node it is linked with."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its links to smaller nodes move to the smallest of these. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a != b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` of every node that has a link; the root is the smallest node it reaches.

    Links of a node to itself and links with nulls are ignored; repeated links do no harm.
    """
    current = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a != b AND a IS NOT NULL AND b IS NOT NULL").distinct(),
        "links",
    )

    def state(links: DataFrame) -> tuple:
        return tuple(
            links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    before = state(current)
    while before[0]:
        current = materialize(_small_star(_large_star(current)), "links")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
