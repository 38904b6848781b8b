"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds ``m``, the least ``b`` of each ``a``. The minima are stored, so that the join can split a node with many edges."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "star-minima")
    return edges.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: numbers), but for the roots; a root is the least node of its component.

    In each round all neighbours above a node, then all below it, are linked to the least one. Nodes come closer to their
    root by halves; the rounds end when the edges no longer change. Minima are partial sums before the shuffle.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        around = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "around")
        large = _with_least(around).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _with_least(materialize(large, "large-star"))
        down = small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(down.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "small-star")
