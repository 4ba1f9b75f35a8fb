import json

import pytest
from pyspark.sql import functions as F

from loomspan.plans.compiler import Engine
from loomspan.plans.graph import Graph
from loomspan.sources import tables
from loomspan.streaming import instances
from tests.conftest import DATA


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(frame, name, mode, folder):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.table(name)


def test_state_of_a_stream_equals_the_batch(spark, stream, tmp_path):
    pytest.importorskip("google.protobuf")
    told = drain(instances.stream_state(stream, "user_id", "event_type", "ts"), "state", "update", f"{tmp_path}/c")
    last = {r.user_id: (r.run_count, r.last_item) for r in told.groupBy("user_id").agg(F.max_by(F.struct("run_count", "last_item"), "run_count").alias("r")).select("user_id", "r.*").collect()}
    batch = instances.totals(spark.read.parquet(f"{DATA}/events.parquet"), "user_id", F.col("event_type"), F.lit(1), F.struct("ts", "event_id"))
    assert last == {r.user_id: (r.run_count, r.last_item) for r in batch.collect()}


def test_windows(spark, stream, tmp_path):
    told = drain(instances.windowed(stream, "ts", "60 days", "1 day", ["event_type"]), "windows", "complete", f"{tmp_path}/c")
    days = spark.read.parquet(f"{DATA}/events.parquet").groupBy(F.to_date("ts"), "event_type").count()
    assert sorted(r.n for r in told.collect()) == sorted(r["count"] for r in days.collect())


def test_graph_over_a_stream(spark, stream, tmp_path):
    graph = Graph.of("g", {"in": ("input", {"label": "event_type"}), "up": ("text_transform", {}), "out": ("output", {})}, [("in.output", "up.text"), ("up.output", "out.input")])
    instances.run_stream(Engine(), graph, stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out")
    assert done.count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert done.where(F.col("out.result") != F.upper("event_type")).count() == 0


def test_files(spark, tmp_path):
    for name, body in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other")):
        (tmp_path / name).write_text(body)
    assert [r.path[-5:] for r in tables.media(spark, str(tmp_path)).orderBy("path").collect()] == ["a.txt", "c.txt"]
    tables.write_events(spark.createDataFrame([("node_complete", "a")], "type string, node_id string"), f"{tmp_path}/events")
    (tmp_path / "requests.json").write_text('{"input_1": "x"}\n')
    assert tables.requests(spark, f"{tmp_path}/requests.json", "input_1 string").first()[0] == "x"
    assert spark.read.json(f"{tmp_path}/events").first()["node_id"] == "a"


def test_keyed_state_of_a_stream_equals_the_batch(spark, tmp_path):
    """Counters, lists and dicts by name; a clear of one name, and of all."""
    pytest.importorskip("google.protobuf")
    rows = [(1, "n", "increment", "2"), (1, "n", "increment", "3"), (1, "l", "append", "a"), (1, "l", "append", "b"), (1, "d", "update", '{"x": "1", "y": "2"}'), (1, "d", "update", '{"x": "3"}'), (1, "v", "set", "p"), (1, "v", "set", "q"),
            (2, "n", "increment", "9"), (2, "l", "append", "z"), (2, "n", "clear", None), (2, "n", "increment", "1"), (3, "n", "increment", "9"), (3, "l", "append", "z"), (3, None, "clear", None), (3, "l", "append", "y")]
    ops = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "at long, id long, name string, op string, value string")
    state = {(r["id"], r["name"]): (r.counter, list(r["items"]), r.fields, r["value"]) for r in instances.keyed_state(ops, "id", F.col("at")).collect()}
    assert state == {(1, "n"): (5, [], None, None), (1, "l"): (None, ["a", "b"], None, None), (1, "d"): (None, [], {"x": "3", "y": "2"}, None), (1, "v"): (None, [], None, "q"), (2, "n"): (1, [], None, None), (2, "l"): (None, ["z"], None, None), (3, "l"): (None, ["y"], None, None)}
    ops.coalesce(1).orderBy("at").write.parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/ops")
    told = drain(instances.stream_keyed_state(stream, "id"), "keyed", "update", f"{tmp_path}/c").collect()
    last = {}
    for r in told:
        last[r["id"], r["name"]] = r.state and json.loads(r.state)
    assert last[1, "n"] == {"counter": 5} and last[1, "l"] == {"items": ["a", "b"]} and last[1, "d"] == {"fields": {"x": "3", "y": "2"}}
    assert last[1, "v"] == {"value": "q"} and last[2, "n"] == {"counter": 1} and last[3, None] is None and last[3, "l"] == {"items": ["y"]}


def test_an_instance_hands_its_conversation_on(spark, tmp_path):
    graph = Graph.of("talk", {"m": ("input", {"label": "message"}), "k": ("input", {"label": "_context_key_last"}), "chat": ("immutable_chat", {}), "r": ("output", {})}, [("m.output", "chat.message"), ("k.output", "chat.context_key"), ("chat.response", "r.input")])
    made = instances.Instances(spark, str(tmp_path), Engine(graphs={"talk": graph}))
    name = made.create("talk")
    for turn in (1, 2, 3):
        body = json.loads(made.execute(name, spark.createDataFrame([(f"hé {turn}",)], "message string")).first().body)
        assert body["r"]["result"] == f"[MOCK MOCK] Turn {turn} response to: hé {turn}"
    made.reset(name)
    assert "Turn 1" in made.execute(name, spark.createDataFrame([("x",)], "message string")).first().body
