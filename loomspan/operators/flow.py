"""Inputs, outputs and nested graphs."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as texts
from .base import Built, Call, NodeType, Value


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "flag"
    if isinstance(kind, T.NumericType):
        return "number"
    return "json" if isinstance(kind, T.VariantType) else "other"


def _input(call: Call) -> Built:
    """The column named by the label, by rank among the inputs, or by the node's id, or the default: the first that is
    not null. Then read as its data type."""
    given: dict[str, Value] = call.env["given"]
    label = str(call.params.get("label", "")).strip()
    names = [n for n in (label, f"input_{call.env['rank']}", call.node_id) if n and n in given]
    values = [given[n] for n in names]
    default = call.params.get("value", "")
    if isinstance(default, (dict, list)):
        default = json.dumps(default)
    if default is not None:
        values.append(Value(F.lit(default), _kind(T.StringType()) if isinstance(default, str) else "number"))
    data_type = call.params.get("data_type", "text")
    if data_type == "text" and len(values) > 1 and {v.kind for v in values[:-1]} == {values[0].kind} != {"text"} and values[-1].kind == "text":
        values = values[:-1]  # a typed column keeps its type; the default is text
    if not values:
        values = [Value(F.lit(None).cast("string"))]
    kind = values[0].kind
    first = F.coalesce(*[v.col if v.kind == kind else v.text() for v in values])
    if data_type == "json" and kind == "text":
        return Built({"output": Value(F.coalesce(F.try_parse_json(first), first.cast("variant")), "json", raw=first)})
    if data_type == "number" and kind == "text":
        return Built({"output": Value(texts.number(first), "number", ~F.contains(first, F.lit(".")))})
    return Built({"output": Value(first, kind, values[0].whole, None if values[0].raw is None else F.when(values[0].col.isNotNull(), values[0].raw))})


def _output(call: Call) -> Built:
    return Built({"result": call.get("input"), "label": Value(F.lit(call.params.get("label", "Output")))})


def _mapping(value: Any) -> dict[str, str]:
    if isinstance(value, str):
        value = json.loads(value) if value.strip() else {}
    return value or {}


def _subgraph(call: Call) -> Built:
    """The named graph, inlined: ports are given to its inputs as ``input_mapping`` says, its output nodes are returned
    under the names of ``output_mapping`` (else by id). ``shared_context`` and ``inherit_context`` also hand down the
    inputs of the outer graph."""
    inner = call.env["graphs"].get(call.params.get("graph") or call.params.get("graph_id") or call.params.get("graph_name"))
    if inner is None:
        return Built({}, F.lit(f"Subgraph not found: {call.params.get('graph')}"))
    isolation = call.params.get("isolation_mode", "isolated")
    given = dict(call.env["given"]) if isolation in ("shared_context", "inherit_context", "shared", "inherited") else {}
    given |= {to: call.inputs[port] for port, to in _mapping(call.params.get("input_mapping")).items() if port in call.inputs}
    if "trigger" in call.inputs:
        given["_trigger"] = call.inputs["trigger"]
    frame, made, failed = call.env["inline"](call.frame, inner, given, call.node_id)
    names = _mapping(call.params.get("output_mapping")) or {n.id: n.id for n in inner.outputs()}
    ports = {name: made[node]["result"] for node, name in names.items() if node in made}
    ports["result"] = next(iter(ports.values()), Value(F.lit(None).cast("string")))
    info = {"subgraph_name": inner.name, "node_count": len(inner.nodes), "isolation_mode": isolation, "output_nodes": list(names)}
    ports["execution_info"] = Value(F.lit(json.dumps(info)))
    return Built(ports, None if failed is None else failed["message"], frame)


def _dynamic_graph(call: Call) -> Built:
    """A nested graph whose ports follow from its schema: inputs ``input_<k>``, outputs by label, lower-cased with
    underscores."""
    inner = call.env["graphs"].get(call.params.get("graph") or call.params.get("graph_id") or call.params.get("graph_name"))
    if inner is None:
        return Built({}, F.lit(f"Subgraph not found: {call.params.get('graph')}"))
    ins = {f"input_{k}": f"input_{k}" for k in range(1, len(inner.inputs()) + 1)}
    outs = {n.id: str(n.params.get("label", "Output")).lower().replace(" ", "_") for n in inner.outputs()}
    params = call.params | {"input_mapping": ins, "output_mapping": outs}
    return _subgraph(Call(call.frame, call.node_id, call.inputs, params, call.env))


FLOW = [
    NodeType("input", "Input/Output", {}, ("output",), _input, {"label": "", "value": "", "data_type": "text"}),
    NodeType("output", "Input/Output", {"input": True}, ("result", "label"), _output, {"label": "Output"}),
    NodeType("subgraph", "Composition", {}, ("result", "execution_info"), _subgraph, {"graph": "", "input_mapping": "{}", "output_mapping": "{}", "isolation_mode": "isolated"}),
    NodeType("dynamic_graph", "Composition", {}, ("result", "execution_info"), _dynamic_graph, {"graph": "", "isolation_mode": "isolated"}),
]
