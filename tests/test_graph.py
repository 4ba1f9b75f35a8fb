import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.operators import BUILT_IN, NodeType, Registry
from loomspan.operators.plugins import AUTO_PROCESSOR
from loomspan.plans.compiler import Engine
from loomspan.plans.graph import Edge, Graph, Node
from loomspan.queries import shout
from loomspan.sources.catalog import Catalog
from loomspan.streaming.instances import Instances


def upper():
    return Graph.of("upper", {"in": ("input", {"value": "Hello World"}), "up": ("text_transform", {"operation": "uppercase"}), "out": ("output", {"label": "Result"})}, [("in.output", "up.text"), ("up.output", "out.input")])


def one(spark, graph, engine=None, **inputs):
    schema = ", ".join(f"`{k}` {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in inputs.items())
    rows = spark.createDataFrame([tuple(inputs.values())], schema) if inputs else spark.range(1).drop("id").withColumn("none", F.lit(1))
    return (engine or Engine()).run(graph, rows).first()


def test_validation():
    loop = Graph.of("g", {"a": ("input", {}), "b": ("output", {})}, [("a.output", "b.input"), ("b.result", "a.x")])
    assert loop.problems() == ["Graph contains cycles"]
    lost = Graph.of("g", {"a": ("input", {})}, [("a.output", "x.text")])
    assert lost.problems() == ["Graph contains cycles", "Edge references non-existent target node: x"]
    twice = Graph.of("g", {"a": ("input", {}), "b": ("text_transform", {})}, [("a.output", "b.text")] * 2)
    assert twice.problems() == ["Duplicate edge: a.output -> b.text"]


@given(st.integers(1, 12), st.data())
def test_order_respects_edges(n, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] < p[1]), unique=True, max_size=20))
    names = data.draw(st.permutations([f"n{i}" for i in range(n)]))
    graph = Graph("g", {k: Node(k, "input") for k in sorted(names)}, tuple(Edge(names[a], "x", names[b], f"y{a}") for a, b in pairs))
    order = graph.order()
    assert sorted(order) == sorted(names)
    assert all(order.index(names[a]) < order.index(names[b]) for a, b in pairs)
    levels, left = graph.levels()
    assert not left and sorted(k for level in levels for k in level) == sorted(names)


@pytest.mark.parametrize(
    ("inputs", "result"),
    [
        ({}, "POTATO FARMERS OF THE WORLD UNITE !!!"),
        ({"input_1": "Elite potato farmers from Idaho"}, "ELITE POTATO FARMERS FROM IDAHO UNITE !!!"),
        ({"input_1": "Elite potato farmers from Idaho", "input_2": "FIGHT THE POWER", "input_3": "FOR BETTER SPUDS!!!"}, "ELITE POTATO FARMERS FROM IDAHO FIGHT THE POWER FOR BETTER SPUDS!!!"),
        ({"input_1": "Elite potato farmers from Idaho", "input_2": "UNITE FOR BETTER SPUDS"}, "ELITE POTATO FARMERS FROM IDAHO UNITE FOR BETTER SPUDS !!!"),
        ({"input_1": "Elite farmers"}, "ELITE FARMERS UNITE !!!"),
    ],
)
def test_golden_graph(spark, inputs, result):
    assert one(spark, shout(), **inputs)["out"]["result"] == result


def test_the_first_example(spark):
    row = one(spark, upper(), input_1="test message from user!")
    assert row["out"].asDict() == {"result": "TEST MESSAGE FROM USER!", "label": "Result"} and row["status"] == "completed"
    assert one(spark, upper())["out"]["result"] == "HELLO WORLD"


def test_rows_equal_single_runs(spark):
    rows = spark.createDataFrame([(t,) for t in ("a", "", None, "ß é")], "input_1 string")
    many = [r["out"]["result"] for r in Engine().run(upper(), rows).collect()]
    assert many == [one(spark, upper(), input_1=t)["out"]["result"] for t in ("a", "", None, "ß é")]


def test_failures(spark):
    g = Graph.of("g", {"a": ("input", {}), "b": ("text_transform", {}), "c": ("output", {})}, [("b.output", "c.input")])
    row = one(spark, g)
    assert row["status"] == "failed" and row["c"] is None
    assert row["errors"] == {"b": "Node b failed: Invalid inputs for node b. Missing required inputs: ['text']"}
    assert row["node_status"] == {"a": "completed", "b": "failed", "c": "pending"}
    record = Engine().execute(g, spark.range(1)).first()
    assert record["outputs"] == "{}" and record["errors"]["execution"].startswith("Graph execution failed: Node b failed")
    with pytest.raises(ValueError, match="Unknown node type: t"):
        one(spark, Graph.of("g", {"a": ("t", {})}, []))
    bad = Graph.of("g", {"a": ("input", {}), "c": ("output", {})}, [("a.result", "c.input")])
    with pytest.raises(ValueError, match="No such port"):
        one(spark, bad)
    assert one(spark, bad, Engine(lenient=True))["status"] == "failed"
    with pytest.raises(Exception, match="Graph execution failed"):
        Engine().run(g, spark.range(1), on_error="raise").collect()


def test_nested_graphs(spark):
    outer = Graph.of("o", {"x": ("input", {"label": "text"}), "s": ("dynamic_graph", {"graph": "upper"}), "o": ("output", {})}, [("x.output", "s.input_1"), ("s.result", "o.input")])
    assert one(spark, outer, Engine(graphs={"upper": upper()}), text="deep")["o"]["result"] == "DEEP"
    self_ = Graph.of("o", {"s": ("subgraph", {"graph": "o"}), "out": ("output", {})}, [("s.result", "out.input")])
    with pytest.raises(ValueError, match="nested more than"):
        one(spark, self_, Engine(graphs={"o": self_}))
    lost = one(spark, Graph.of("o", {"s": ("subgraph", {"graph": "none"})}, []))
    assert lost["errors"]["s"].endswith("Subgraph not found: none")


def test_files_and_schema(spark):
    again = Graph.from_json(shout().to_json())
    assert again == shout()
    with pytest.raises(ValueError):
        Graph.from_json("{}")
    rows = [tuple(r) for r in shout().schema(spark).collect()]
    assert [r[:4] for r in rows] == [("input", "a", 1, "input_1"), ("input", "b", 2, "input_2"), ("input", "c", 3, "input_3"), ("output", "out", None, "result")]


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    made = catalog.create(upper())
    assert catalog.find("UPPER")[0] == catalog.find(made)[0] == made and catalog.find("no") is None
    catalog.load(upper().to_json())
    catalog.copy("upper")
    assert [r["name"] for r in catalog.list().collect()] == ["upper", "upper (Copy)", "upper (Imported 1)"]
    catalog.update("upper (Copy)", Graph("second", upper().nodes, upper().edges))
    catalog.delete("upper (Imported 1)")
    assert [r["name"] for r in catalog.list().collect()] == ["second", "upper"]
    assert catalog.list(1, 1).first()["name"] == "upper"
    name, body = catalog.export("upper")
    assert name == "upper.json" and json.loads(body)["graph"]["name"] == "upper"
    catalog.record(Engine().execute(upper(), spark.range(3)))
    assert catalog.executions("upper", "completed").count() == 3 and catalog.executions(status="failed").count() == 0
    with pytest.raises(KeyError):
        catalog.delete("no")


def test_registry(spark):
    registry = Registry(BUILT_IN.values())
    extra = NodeType("text_concat", "Mine", {"a": True}, ("b",), lambda c: None)
    assert registry.register(extra) and registry["text_concat"].category == "Mine"
    assert not registry.register(extra)
    found = Registry(BUILT_IN.values())
    assert "example_processor" in found.discover("loomspan.operators")
    spec = {r["node_type"]: r for r in registry.specs(spark).collect()}
    assert spec["json_replace"]["required"] == ["data", "value"]
    auto = Registry([*BUILT_IN.values(), AUTO_PROCESSOR])
    g = Graph.of("g", {"i": ("input", {"value": "a b"}), "p": ("example_processor", {}), "f": ("simple_text_processor", {}), "o": ("output", {})}, [("i.output", "p.input"), ("p.count_string", "f.text"), ("f.result", "o.input")])
    assert one(spark, g, Engine(registry=auto))["o"]["result"] == "2 words !!!"


def test_context_token(spark):
    g = Graph.of("t", {"m": ("input", {"value": "hi"}), "c": ("immutable_chat", {}), "s": ("smart_chat", {}), "o": ("output", {})}, [("m.output", "c.message"), ("m.output", "s.message"), ("c.response", "o.input")])
    row = one(spark, g)
    assert row["context_token"].startswith("ctx_")  # the later node's
    assert "context_token" not in one(spark, upper()).asDict()


def test_manifests(spark, tmp_path):
    (tmp_path / "mine.py").write_text("from loomspan.operators import Built, NodeType, Value\nTWICE = NodeType('twice', 'Mine', {'text': True}, ('result',), lambda c: Built({'result': Value(__import__('pyspark').sql.functions.repeat(c.get('text').col, __import__('pyspark').sql.functions.lit(2)))}))\n")
    (tmp_path / "plugin.yaml").write_text('name: my-plugin\nversion: "1.0"\nentry_point: mine.py\n')
    registry = Registry(BUILT_IN.values())
    assert registry.load_manifest(f"{tmp_path}/plugin.yaml") == ["twice"]
    g = Graph.of("g", {"i": ("input", {"value": "ab"}), "t": ("twice", {}), "o": ("output", {})}, [("i.output", "t.text"), ("t.result", "o.input")])
    assert one(spark, g, Engine(registry=registry))["o"]["result"] == "abab"
    (tmp_path / "plugin.yaml").write_text("name: x\n")
    with pytest.raises(ValueError, match="version, entry_point"):
        registry.load_manifest(f"{tmp_path}/plugin.yaml")


def test_instances(spark, tmp_path):
    chat = Graph.of("chat", {"m": ("input", {"label": "text"}), "b": ("input", {"label": "_context_key_last", "value": "none"}), "c": ("immutable_chat", {}), "o": ("output", {}), "p": ("output", {})}, [("m.output", "c.message"), ("c.response", "o.input"), ("b.output", "p.input")])
    instances = Instances(spark, str(tmp_path), Engine(graphs={"chat": chat}))
    made = instances.create("chat")
    assert made.startswith("gi_") and len(made) == 11
    rows = spark.createDataFrame([("hi",)], "text string")
    first = json.loads(instances.execute(made, rows).first()["body"])
    second = json.loads(instances.execute(made, rows).first()["body"])
    assert first["p"]["result"] == "none" and second["p"]["result"] == first["context_token"]
    assert instances.get(made)["run_count"] == 2 and instances.runs(made).count() == 2 and instances.list("chat").count() == 1
    instances.reset(made)
    assert instances.get(made)["state"] == {}
    instances.delete(made)
    with pytest.raises(KeyError):
        instances.get(made)
    with pytest.raises(KeyError):
        instances.create("none")
