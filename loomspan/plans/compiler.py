"""Graphs compiled to DataFrame expressions: one run over N rows is one Spark job, whatever the graph.

Every node adds its ports as columns, and a reason why it fails in this row if it can. The first failure in the graph's
order decides the row's status; nodes after it are pending. A caller who selects some outputs leaves the rest to
Catalyst to prune; failures of unselected nodes still count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import BUILT_IN, Call, Registry, Value
from ..operators.flow import _kind
from .graph import Edge, Graph, Node

#: Nested graphs in nested graphs.
DEEPEST = 20


@dataclass
class Engine:
    """``graphs``: by name, for nested ones. ``store``: table of stored contexts, ``contexts``: of conversations (context_key,
    messages) that chats continue. ``now``: a fixed time as text, for results that
    don't change. ``providers``: callables by name. ``lenient``: a port that doesn't exist has no value, instead of
    being an error when the graph is compiled."""

    registry: Registry = field(default_factory=lambda: Registry(BUILT_IN.values()))
    graphs: dict[str, Graph] = field(default_factory=dict)
    store: DataFrame | None = None
    contexts: DataFrame | None = None
    now: str | None = None
    providers: dict[str, Callable[[str], str]] = field(default_factory=dict)
    lenient: bool = False

    def run(self, graph: Graph, rows: DataFrame, keep: list[str] | None = None, on_error: str = "row") -> DataFrame:
        """``rows`` (or its columns ``keep``) with a column for each output node, named by its id: struct(result, label);
        and ``status``, ``errors`` and ``node_status`` of the row, and ``context_token``, the last one that a node made, if
        any makes one, and ``context_write``, the conversation to be written under it, if there are chats. A failed row has
        null outputs. ``on_error="raise"``
        makes the job fail with the first row that does."""
        for problem in graph.problems():
            raise ValueError(problem)
        given = {c: Value(F.col(f"`{c}`"), _kind(rows.schema[c].dataType)) for c in rows.columns}
        frame, made, failed = self._inline(rows, graph, given, "", 0)
        frame = frame.withColumn("__failed", failed if failed is not None else F.lit(None).cast("struct<at:int,node:string,message:string>"))
        fine = F.col("__failed").isNull()
        if on_error == "raise" and failed is not None:
            frame = frame.withColumn("__failed", F.when(F.col("__failed").isNull(), F.col("__failed")).otherwise(F.raise_error(F.concat(F.lit("Graph execution failed: "), F.col("__failed.message"))).cast("struct<at:int,node:string,message:string>")))
        outs = [F.when(fine, F.struct(made[n.id]["result"].col.alias("result"), made[n.id]["label"].col.alias("label"))).alias(n.id) for n in graph.outputs()]
        states = []
        for k, name in enumerate(graph.order()):
            at = F.col("__failed.at")
            states += [F.lit(name), F.when(at.isNull() | (at > k), "completed").when(at == k, "failed").otherwise("pending")]
        tokens = [made[k][p].col.cast("string") for k in reversed(graph.order()) for p in ("context_token", "context_id", "context_key") if p in made[k] and graph.nodes[k].type != "input"]
        token = [F.when(fine, F.coalesce(*[F.nullif(t, F.lit("")) for t in tokens])).alias("context_token")] if tokens else []
        chats = [made[k]["write"].col for k in reversed(graph.order()) if "write" in made[k] and "message_count" in made[k]]
        token += [F.when(fine, F.coalesce(*chats)).alias("context_write")] if chats else []
        return frame.select(
            *[F.col(f"`{c}`") for c in (rows.columns if keep is None else keep)],
            *outs,
            *token,
            F.when(fine, "completed").otherwise("failed").alias("status"),
            F.when(~fine, F.create_map(F.col("__failed.node"), F.col("__failed.message"))).alias("errors"),
            F.create_map(*states).alias("node_status"),
        )

    def execute(self, graph: Graph, rows: DataFrame) -> DataFrame:
        """Records of executions: ``outputs`` as JSON by node, and errors as the recorded entry point tells them."""
        done = self.run(graph, rows, keep=[])
        names = [n.id for n in graph.outputs()]
        ok = F.col("status") == "completed"
        message = F.concat(F.lit("Graph execution failed: "), F.map_values("errors")[0])
        return done.select(F.lit(graph.name).alias("graph"), "status", F.when(ok, F.to_json(F.struct(*names))).otherwise("{}").alias("outputs"), "node_status", F.when(~ok, F.create_map(F.lit("execution"), message)).alias("errors"))

    def events(self, graph: Graph, rows: DataFrame, keep: list[str]) -> DataFrame:
        """What a stream of one execution would tell, a row each: a chunk for each streaming node (its whole response),
        every node's end, and the end of all with its outputs as JSON; ``position`` is the order within an execution."""
        streaming = {k: n for k, n in graph.nodes.items() if self.registry[n.type].streams}
        taps = {f"__chunk_{k}": Node(f"__chunk_{k}", "output", {}) for k in streaming}
        tapped = Graph(graph.name, graph.nodes | taps, (*graph.edges, *[Edge(k, "response", f"__chunk_{k}", "input") for k in streaming]), graph.description)
        done = self.run(tapped, rows, keep=None)
        state = F.col("node_status")
        none = F.lit(None).cast("string")

        def event(kind: str, node: str | None, status: Column, chunk: Column = none, outputs: Column = none) -> Column:
            return F.struct(F.lit(kind).alias("type"), F.lit(node).cast("string").alias("node_id"), status.alias("status"), chunk.alias("chunk"), outputs.alias("outputs"))

        each: list[Column] = []
        for name in graph.order():
            ended = F.element_at(state, name) == "completed"
            if name in streaming:
                each.append(F.when(ended, event("node_chunk", name, F.lit("running"), F.col(f"__chunk_{name}.result").cast("string"))))
            each.append(F.when(ended, event("node_complete", name, F.lit("completed"))))
        outputs = F.to_json(F.struct(*[F.col(n.id) for n in graph.outputs()])) if graph.outputs() else none
        last = F.when(F.col("status") == "completed", event("execution_complete", None, F.col("status"), outputs=outputs)).otherwise(event("execution_error", None, F.col("status")))
        told = F.filter(F.array(*each, last), lambda e: e.isNotNull())
        return done.select(*keep, F.posexplode(told).alias("position", "event")).select(*keep, "position", "event.*")

    def _inline(self, frame: DataFrame, graph: Graph, given: dict[str, Value], prefix: str, depth: int) -> tuple[DataFrame, dict[str, dict[str, Value]], Column | None]:
        if depth > DEEPEST:
            raise ValueError(f"graphs are nested more than {DEEPEST} deep")
        ranks = {n.id: k for k, n in enumerate(graph.inputs(), 1)}
        made: dict[str, dict[str, Value]] = {}
        failures: list[Column] = []
        for position, name in enumerate(graph.order()):
            node = graph.nodes[name]
            kind = self.registry.get(node.type)
            if kind is None:
                raise ValueError(f"Unknown node type: {node.type}")
            inputs: dict[str, Value] = {}
            ports = {e.target_port for e in graph.edges if e.target == name}
            for port in kind.inputs.keys() | ports:
                if (edge := graph.source_of(name, port)) is None:
                    continue
                found = made[edge.source].get(edge.source_port)
                if found is None or (port not in kind.inputs and node.type not in ("subgraph", "dynamic_graph")):
                    if self.lenient:
                        continue
                    raise ValueError(f"No such port: {edge.source}.{edge.source_port} -> {edge.target}.{edge.target_port}")
                inputs[port] = found
            for port, default in kind.defaults.items():  # where nothing is connected, or null
                given_value = inputs.get(port)
                inputs[port] = Value(F.lit(default)) if given_value is None else Value(F.coalesce(given_value.text(), F.lit(default)))
            missing = [p for p, needed in kind.inputs.items() if needed]
            absent = F.filter(F.array(*[F.when(inputs[p].col.isNull() if p in inputs else F.lit(True), p) for p in missing]), lambda p: p.isNotNull()) if missing else None
            full = f"{prefix}{name}"
            env: dict[str, Any] = {"given": given, "rank": ranks.get(name), "graphs": self.graphs, "store": self.store, "contexts": self.contexts, "now": self.now, "providers": self.providers}
            env["inline"] = lambda f, g, i, n, d=depth: self._inline(f, g, i, f"{n}__", d + 1)
            built = kind.build(Call(frame, full, inputs, kind.params | node.params, env))
            frame = built.frame if built.frame is not None else frame
            reasons = []
            if absent is not None:
                said = F.concat(F.lit(f"Invalid inputs for node {name}. Missing required inputs: ['"), F.array_join(absent, "', '"), F.lit("']"))
                reasons.append(F.when(F.size(absent) > 0, said))
            if built.error is not None:
                reasons.append(built.error)
            columns = {f"{full}__{port}": v.col for port, v in built.ports.items()}
            frame = frame.withColumns(columns)
            made[name] = {port: Value(F.col(f"`{full}__{port}`"), v.kind) for port, v in built.ports.items()}
            for port, v in built.ports.items():
                more = {what: c for what, c in (("whole", v.whole), ("raw", v.raw)) if c is not None}
                frame = frame.withColumns({f"{full}__{port}__{what}": c for what, c in more.items()})
                made[name][port] = replace(made[name][port], **{what: F.col(f"`{full}__{port}__{what}`") for what in more})
            if reasons:
                why = F.coalesce(*reasons)
                failures.append(F.when(why.isNotNull(), F.struct(F.lit(position).alias("at"), F.lit(name).alias("node"), F.concat(F.lit(f"Node {name} failed: "), why).alias("message"))))
        if not failures:
            return frame, made, None
        column = f"{prefix}__first_failure"
        return frame.withColumn(column, F.coalesce(*failures)), made, F.col(f"`{column}`")


#: Where a client looks for the answer among the outputs, and under what names.
ANSWER_NODES, ANSWER_PORTS = ("chat_response", "output", "result"), ("response", "result", "output")


def reduced(events: DataFrame, key: str) -> DataFrame:
    """What a client shows of each execution's ``events``: ``content``, the chunks in order, or else what it finds among the
    outputs; ``n_events``, ``status`` of the last event, ``token`` for the next message if an output ``new_context`` has one."""
    chunks = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("position", "chunk"))))
    of = events.groupBy(key).agg(chunks.alias("parts"), F.max_by(F.struct("status", "outputs"), "position").alias("end"), F.count("*").alias("n_events"))
    streamed = F.array_join(F.transform("parts", lambda p: p["chunk"]), "")
    found = [F.nullif(F.get_json_object("end.outputs", f"$.{n}.{p}"), F.lit("")) for n in ANSWER_NODES for p in ANSWER_PORTS]
    tokens = [F.get_json_object("end.outputs", f"$.new_context.{p}") for p in ("result", "context_key")]
    content = F.coalesce(F.nullif(streamed, F.lit("")), *found, F.lit("No response found in output nodes"))
    return of.select(key, content.alias("content"), F.col("end.status").alias("status"), "n_events", F.coalesce(*tokens).alias("token"))
