"""Graphs and records of executions as Parquet in a folder."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons
from ..plans.graph import Graph

GRAPHS = "graph_id string, name string, body string, version bigint, deleted boolean"


class Catalog:
    """Graphs by id and name. Each change appends a row; the row with the highest version of an id counts, so nothing
    that a job reads is rewritten under it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/graphs"
        self.records = f"{folder.rstrip('/')}/executions"
        self._write([])

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, GRAPHS).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        rows = self.spark.read.schema(GRAPHS).parquet(self.path)
        last = rows.groupBy("graph_id").agg(F.max_by(F.struct("name", "body", "version", "deleted"), "version").alias("r"))
        return last.select("graph_id", "r.*").where(~F.col("deleted")).drop("deleted")

    def list(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return self.all().select("graph_id", "name").orderBy("name", "graph_id").offset(offset).limit(limit)

    def find(self, name_or_id: str) -> tuple[str, Graph, int] | None:
        """By id, else by name without regard to case (``%`` and ``_`` match as in SQL), the exact name first."""
        rows = self.all().where((F.col("graph_id") == name_or_id) | F.col("name").ilike(name_or_id))
        row = rows.orderBy(F.desc(F.col("graph_id") == name_or_id), F.desc(F.col("name") == name_or_id), "name", "graph_id").first()
        return (row["graph_id"], Graph.from_json(row["body"]), row["version"]) if row else None

    def create(self, graph: Graph) -> str:
        made = str(uuid.uuid4())
        self._write([(made, graph.name, graph.to_json(), 1, False)])
        return made

    def load(self, text: str) -> str:
        """From a graph file; a name that is taken gets a number."""
        graph, k = Graph.from_json(text), 0
        name = graph.name
        taken = {r["name"] for r in self.all().where(F.col("name").startswith(graph.name)).select("name").collect()}
        while name in taken:
            k += 1
            name = f"{graph.name} (Imported {k})"
        return self.create(Graph(name, graph.nodes, graph.edges, graph.description))

    def update(self, name_or_id: str, graph: Graph) -> None:
        at, _, version = self._must(name_or_id)
        self._write([(at, graph.name, graph.to_json(), version + 1, False)])

    def delete(self, name_or_id: str) -> None:
        at, graph, version = self._must(name_or_id)
        self._write([(at, graph.name, graph.to_json(), version + 1, True)])

    def copy(self, name_or_id: str) -> str:
        _, graph, _ = self._must(name_or_id)
        return self.create(Graph(f"{graph.name} (Copy)", graph.nodes, graph.edges, graph.description))

    def export(self, name_or_id: str) -> tuple[str, str]:
        """A file name and the graph file."""
        _, graph, _ = self._must(name_or_id)
        return re.sub(r"[^a-z0-9]+", "_", graph.name.lower()).strip("_") + ".json", graph.to_json()

    def _must(self, name_or_id: str) -> tuple[str, Graph, int]:
        found = self.find(name_or_id)
        if found is None:
            raise KeyError(f"Graph not found: {name_or_id}")
        return found

    def record(self, executions: DataFrame) -> None:
        """Appends what ``Engine.execute`` returns, by graph."""
        executions.withColumn("recorded_at", F.current_timestamp()).write.mode("append").partitionBy("graph").parquet(self.records)

    def executions(self, graph: str | None = None, status: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.records)
        rows = rows if graph is None else rows.where(F.col("graph") == graph)
        return rows if status is None else rows.where(F.col("status") == status)


def matching(objects: DataFrame, equal: dict[str, object], metadata: str = "metadata", values: dict[str, object] | None = None) -> DataFrame:
    """Objects whose columns equal some values, and whose JSON ``metadata`` holds some values under keys of its top level.
    JSON values are compared as they are written: a number isn't a text."""
    for column, value in equal.items():
        objects = objects.where(F.col(column) == F.lit(value))
    parsed = F.try_parse_json(F.col(metadata))
    for k, value in (values or {}).items():
        found = F.to_json(jsons.at(parsed, [k]))
        objects = objects.where(found == F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))))
    return objects


def named_outputs(executions: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each output of each execution (``graph``, ``outputs`` map from node ids), with the ``name`` that its node
    shows: its label, else its type, else its id. Only output nodes count. ``nodes`` is as ``Graph.node_rows`` gives it; one
    row for each node of the catalog, it is broadcast by Spark if it is small."""
    shown = nodes.where(F.col("node_type") == "output").select("graph", "node_id", F.coalesce(F.nullif("label", F.lit("")), "node_type", "node_id").alias("name"))
    return executions.select("*", F.explode("outputs").alias("node_id", "result")).drop("outputs").join(shown, ["graph", "node_id"])
