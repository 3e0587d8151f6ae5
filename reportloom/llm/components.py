"""Connected components of an edge table, by alternating large-star and small-star steps.

Every half step is a grouped minimum and a join, written to the shared folder, so no
list of neighbours is ever gathered, a hub's edges can be split by the adaptive skewed
join, and a lost executor costs one half step. Only a row count and a checksum of the
edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.plans.store import discard, materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node the smallest of its neighbours and itself."""
    return materialize(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _smallest(both)
    out = materialize(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .filter("a <> b").distinct(), "edges")
    discard(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _smallest(down)
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(moved.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    discard(low)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the smallest node reachable from it.

    Repeated edges, both directions and loops are allowed; a node that has only loops is
    left out, as are rows with a null end. An empty table gives an empty table.
    """
    now = materialize(edges.dropna().filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen) or not seen[0]:
            break
        mark, large = tuple(seen), _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
