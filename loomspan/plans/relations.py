"""Graphs as tables: questions about the nodes (``graph``, ``node_id``, ``node_type``) and edges (``graph``, ``source``,
``target``) of many graphs at once. ``Graph.node_rows`` and ``Graph.edge_rows`` give those of one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sum
from ..sources.shared import written


def dangling(edges: DataFrame, nodes: DataFrame, end: str = "target", within: tuple[str, ...] = ("graph",)) -> DataFrame:
    """Edges one of whose ends is no node of their graph (``within=()``: of any)."""
    known = nodes.select(*within, F.col("node_id").alias(end)).distinct()
    return edges.join(known, [*within, end], "left_anti").select(*edges.columns)


def in_degrees(edges: DataFrame) -> DataFrame:
    """How many edges lead to each node."""
    return edges.groupBy("graph", "target").agg(F.count(F.lit(1)).alias("in_degree"))


def repeated(edges: DataFrame) -> DataFrame:
    """Edges that are listed more than once, and how often."""
    return edges.groupBy(*edges.columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def input_keys(nodes: DataFrame) -> DataFrame:
    """The key by which each input node can be given its value: ``input_`` and its rank by id among its graph's inputs."""
    ranked = running_sum(nodes.where(F.col("node_type") == "input").withColumn("node_id", F.col("node_id").cast("string")), ["graph"], ["node_id"], "rank")
    return ranked.select("graph", "node_id", F.concat(F.lit("input_"), F.col("rank").cast("string")).alias("ordinal_key"))


def by_category(types: DataFrame) -> DataFrame:
    """Each member (``category``, ``member``) with the number of its category's. Counts are small where categories are few;
    Spark then broadcasts them, and else splits a category that holds most rows."""
    counts = types.groupBy(F.col("category").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    return types.join(counts, F.col("category").eqNullSafe(F.col("of"))).select("category", "member", "n")


def depths(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, within: tuple[str, ...] = ("graph",)) -> DataFrame:
    """The longest way to each node from one of ``starts`` (rows of ``nodes``; by default those without edges into them): a
    level a round, each written to the shared folder. Nodes that no way leads to have no depth; a way into a cycle, which
    ``Graph.problems`` tells of, is an error."""
    keys = [*within, "node"]
    known = nodes.select(*within, F.col("node_id").alias("node")).distinct()
    used = written(edges.select(*within, F.col("source").alias("node"), "target").distinct().join(known, keys, "left_semi"))
    if starts is None:
        first = known.join(used.select(*within, F.col("target").alias("node")).distinct(), keys, "left_anti")
    else:
        first = starts.select(*within, F.col("node_id").alias("node")).distinct()
    at = written(first.withColumn("depth", F.lit(0)))
    levels, most, depth = at, nodes.count(), 0
    while not at.isEmpty():
        if depth > most:
            raise ValueError("Graph contains cycles")
        reached = used.join(at, keys).select(*within, F.col("target").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        at, depth = written(reached.join(known, keys, "left_semi")), depth + 1
        levels = levels.unionByName(at)
    return levels.groupBy(*keys).agg(F.max("depth").alias("depth"))
