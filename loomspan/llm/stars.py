"""Connected components as a forest of stars, by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node``, ``root``: each node of ``edges`` and the smallest node of its component.

    Every step maps edges to as many edges at most, so nothing grows with the square of a component. A node's least
    neighbour goes to its edges by a join that spreads the edges of hubs. Each result is written to the shared folder, and
    the loop ends when all edges lead from a node to its root. Rows with a null end and loops are ignored; repeated edges
    count once; an empty table gives no rows.
    """
    now = written(edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("hi") != F.col("lo"))).distinct())

    def with_least(rows: DataFrame, node: str, other: str) -> DataFrame:
        """``rows`` with ``m``, the least ``other`` of its ``node``."""
        least = written(rows.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("n_edges")))
        total = least.agg(F.sum("n_edges")).first()[0] or 0
        return spread_join(rows, least, {node: F.col(node)}, {"m": "m"}, "n_edges", total, F.col(other))

    while True:
        ends = now.groupBy("hi").agg(F.count("*").alias("n_lo"))
        if ends.where("n_lo > 1").isEmpty() and ends.join(now.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty():
            break
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("o")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("o")))
        large = with_least(both, "n", "o").where(F.col("o") > F.col("n")).select(F.col("o").alias("hi"), F.least("n", "m").alias("lo"))
        large = written(large.distinct())
        pulled = with_least(large, "hi", "lo").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        now = written(pulled.select("e.*").where(F.col("hi") != F.col("lo")).distinct())
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
