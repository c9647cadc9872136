"""Connected components by alternating stars, with every round's edges written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node that it knows."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    return (
        both.filter("other > node")
        .join(least, "node")
        .select(F.col("other").alias("a"), F.least("node", "least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = down.groupBy("node").agg(F.min("other").alias("least"))
    moved = down.join(least, "node").filter("other <> least").select("other", "least")
    return moved.union(least.select("node", "least")).toDF("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.shiftrightunsigned(F.xxhash64("a", "b"), 24)
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the ``a, b`` edges that isn't the smallest of its component.

    The rounds are logarithmic in the longest path. Loops and repeated edges don't matter, and no
    edges give no rows. Nothing but a count and a sum per round comes to the driver.
    """
    edges = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while (now := _state(edges)) != before:
        if not now[0]:
            break
        before = now
        edges = settle(_small_star(_large_star(edges)), "edges")
    return edges.toDF("node", "root")
