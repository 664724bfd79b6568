"""Connected components of a large link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the component's smallest node.

    Each round hangs every larger neighbour of a node on the node's smallest one, then does
    the same with the smaller neighbours, until nothing changes (about the square of the
    logarithm of the longest path). Steps are grouped minima, which combine before the shuffle,
    and joins, which split hot nodes; each round is written to the shared folder. Nulls, loops
    and repeated links are dropped; an empty table gives no rows.
    """
    edges = materialise(_tidy(links.select("a", "b")))
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _tidy(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"),
                                                                   F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        rest = large.join(least.withColumnRenamed("b", "m"), "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(_tidy(rest.union(least)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    """Larger node first, each link once, no loops."""
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a <> b").distinct())


def _mark(edges: DataFrame) -> tuple:
    """One row that tells link tables apart."""
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())
