"""Graphs of nodes: reading, writing, validation, order, description."""

from __future__ import annotations

import json
from collections import Counter, deque
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    source_port: str
    target: str
    target_port: str


@dataclass(frozen=True)
class Graph:
    name: str
    nodes: dict[str, Node]
    edges: tuple[Edge, ...] = ()
    description: str = ""

    @staticmethod
    def of(name: str, nodes: dict[str, tuple[str, dict]], edges: list[tuple[str, str]]) -> Graph:
        """A short form: nodes as id -> (type, parameters), edges as ("id.port", "id.port")."""
        ends = [(*a.split(".", 1), *b.split(".", 1)) for a, b in edges]
        return Graph(name, {k: Node(k, t, p) for k, (t, p) in nodes.items()}, tuple(Edge(*e) for e in ends))

    @staticmethod
    def from_json(text: str) -> Graph:
        """From a graph file, whose envelope holds name, nodes and edges under ``graph``."""
        whole = json.loads(text)
        body = whole.get("graph") if isinstance(whole, dict) else None
        if not isinstance(body, dict) or not {"name", "nodes", "edges"} <= body.keys():
            raise ValueError("a graph file needs 'graph' with name, nodes and edges")
        nodes = {k: Node(k, n["node_type"], n.get("parameters") or {}) for k, n in body["nodes"].items()}
        edges = tuple(Edge(e["source_node"], e["source_port"], e["target_node"], e["target_port"]) for e in body["edges"])
        return Graph(body["name"], nodes, edges, body.get("description") or "")

    def to_json(self) -> str:
        nodes = {k: {"node_id": k, "node_type": n.type, "parameters": n.params} for k, n in self.nodes.items()}
        edges = [{"edge_id": f"{e.source_port}-{e.target_port}", "source_node": e.source, "source_port": e.source_port, "target_node": e.target, "target_port": e.target_port} for e in self.edges]
        return json.dumps({"version": "1.0", "graph": {"name": self.name, "description": self.description, "nodes": nodes, "edges": edges}}, ensure_ascii=False)

    def levels(self) -> tuple[list[list[str]], list[str]]:
        """Node ids by distance from the start, in the order in which they become free; and the ids that never do."""
        degree = dict.fromkeys(self.nodes, 0)
        for e in self.edges:
            degree[e.target] = degree.get(e.target, 0) + 1
        free = [k for k in self.nodes if not degree[k]]
        out: list[list[str]] = []
        done: set[str] = set()
        while free:
            out.append(free)
            done.update(free)
            then: list[str] = []
            for k in free:
                for e in self.edges:
                    if e.source == k and e.target in degree:
                        degree[e.target] -= 1
                        if not degree[e.target]:
                            then.append(e.target)
            free = [k for k in then if k in self.nodes]
        return out, [k for k in self.nodes if k not in done]

    def order(self) -> list[str]:
        """Node ids so that every edge points forward; first in, first out."""
        degree = Counter(e.target for e in self.edges)
        wait, out = deque(k for k in self.nodes if not degree[k]), []
        while wait:
            k = wait.popleft()
            out.append(k)
            for e in self.edges:
                if e.source == k:
                    degree[e.target] -= 1
                    if not degree[e.target] and e.target in self.nodes:
                        wait.append(e.target)
        return out

    def problems(self) -> list[str]:
        """What makes the graph invalid; empty if nothing does."""
        out = []
        if len(self.order()) < len(self.nodes) or any(e.target not in self.nodes for e in self.edges):
            out.append("Graph contains cycles")
        for e in self.edges:
            if e.source not in self.nodes:
                out.append(f"Edge references non-existent source node: {e.source}")
            if e.target not in self.nodes:
                out.append(f"Edge references non-existent target node: {e.target}")
        for e, n in Counter(self.edges).items():
            out += [f"Duplicate edge: {e.source}.{e.source_port} -> {e.target}.{e.target_port}"] * (n - 1)
        return out

    def source_of(self, node: str, port: str) -> Edge | None:
        """The edge into a port; the first one listed wins."""
        return next((e for e in self.edges if e.target == node and e.target_port == port), None)

    def inputs(self) -> list[Node]:
        return sorted((n for n in self.nodes.values() if n.type == "input"), key=lambda n: n.id)

    def outputs(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.type == "output"]

    def schema(self, spark: SparkSession) -> DataFrame:
        """The inputs and outputs of the graph, as rows."""
        rows = [("input", n.id, i, f"input_{i}", str(n.params.get("label", "")).strip() or None, n.params.get("data_type", "text"), str(n.params.get("value", ""))) for i, n in enumerate(self.inputs(), 1)]
        rows += [("output", n.id, None, "result", n.params.get("label", "Output"), None, None) for n in self.outputs()]
        return spark.createDataFrame(rows, "direction string, node_id string, ordinal int, key string, label string, data_type string, default_value string")

    def node_rows(self, spark: SparkSession) -> DataFrame:
        """The graph's nodes as rows, to be joined with what executions tell."""
        rows = [(self.name, n.id, n.type, str(n.params.get("label", "")).strip() or None) for n in self.nodes.values()]
        return spark.createDataFrame(rows, "graph string, node_id string, node_type string, label string")

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        """The graph's edges as rows."""
        rows = [(self.name, e.source, e.source_port, e.target, e.target_port) for e in self.edges]
        return spark.createDataFrame(rows, "graph string, source string, source_port string, target string, target_port string")
