"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.select(F.col("v").alias("u"), F.col("w").alias("n")).unionByName(
        edges.select(F.col("w").alias("u"), F.col("v").alias("n")))
    least = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("n > u").join(least, "u")
            .select(F.col("n").alias("v"), F.col("m").alias("w")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("v").agg(F.min("w").alias("m"))
    moved = edges.join(least, "v").filter("w > m").select(F.col("w").alias("v"), F.col("m").alias("w"))
    return moved.unionByName(least.select("v", F.col("m").alias("w"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(v, w): every node of ``edges`` (v, w with w < v) but the least of its component, and that
    least node.  Ends when a round changes nothing; each round is written to the shared folder."""
    edges = written(edges.distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return edges
        last = mark
        edges = written(_small_star(_large_star(edges)), "edges")
