"""Connected components of a table of edges, by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.scratch import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star: every vertex hangs below the least of its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    # now b < a: the smaller neighbours of a vertex meet below the least of them
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component``, its least reachable vertex, for the ends of the edges ``a`` and ``b``.

    Every round halves distances and never holds more rows than there are edges; the joins are on
    vertices whose rows adaptive execution splits where many edges meet. Done when every vertex has
    one edge, to a vertex without one.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        following = written(_stars(now))
        rows = following.count()
        if rows == now.count() and following.join(now, ["a", "b"], "left_anti").isEmpty():
            break
        now = following
    ends = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return ends.union(roots)
