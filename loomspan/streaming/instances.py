"""Instances: a graph with state that outlives a run. On a batch, state is told by an instance's runs in order; on a
stream, it is Structured Streaming's keyed state, and both give the same totals."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import ordered
from ..operators.chat import MESSAGES
from ..plans.compiler import Engine
from ..plans.graph import Graph


def run_counts(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``runs`` with ``run_count``: which run of its instance each is."""
    return ordered.running_sum(runs, [key], order, "run_count")


def totals(runs: DataFrame, key: str, item: Column, counter: Column, order: Column) -> DataFrame:
    """The state after all runs, a row for each instance: how many, the sum of a counter, the last item."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("run_count"), F.sum(counter).alias("counter"), F.max_by(item, order).alias("last_item"))


def with_previous(runs: DataFrame, key: str, order: list[str], outputs: list[str]) -> DataFrame:
    """``runs`` with ``_context_key_<column>`` of the run before, for graphs whose inputs name it."""
    return ordered.previous(runs, [key], order, {f"_context_key_{c}": c for c in outputs})


LOG = "instance_id string, graph string, run_count long, state map<string,string>, active boolean, version long"


class Instances:
    """Instances in a folder: each change appends a row, and the highest version of an id counts. Runs are recorded
    beside them. Ids are ``gi_`` and 8 hex digits."""

    def __init__(self, spark: SparkSession, folder: str, engine: Engine):
        self.spark, self.engine = spark, engine
        self.path, self.history, self.talks = (f"{folder.rstrip('/')}/{n}" for n in ("instances", "instance_runs", "instance_contexts"))
        self._write([])
        spark.createDataFrame([], f"context_key string, messages {MESSAGES}").write.mode("append").parquet(self.talks)

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LOG).write.mode("append").parquet(self.path)

    def list(self, graph: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(LOG).parquet(self.path).groupBy("instance_id").agg(F.max_by(F.struct("graph", "run_count", "state", "active", "version"), "version").alias("r")).select("instance_id", "r.*").where("active")
        return rows if graph is None else rows.where(F.col("graph") == graph)

    def get(self, instance: str) -> dict[str, Any]:
        row = self.list().where(F.col("instance_id") == instance).first()
        if row is None:
            raise KeyError(f"Instance not found: {instance}")
        return row.asDict()

    def create(self, graph: str) -> str:
        if graph not in self.engine.graphs:
            raise KeyError(f"Graph not found: {graph}")
        made = f"gi_{uuid.uuid4().hex[:8]}"
        self._write([(made, graph, 0, {}, True, 1)])
        return made

    def execute(self, instance: str, rows: DataFrame) -> DataFrame:
        """Runs the instance's graph on ``rows``, with the context token of the run before as input ``_context_key_last``;
        chats load that context from the contexts that earlier runs wrote. The results are recorded, and returned as
        recorded."""
        now = self.get(instance)
        given = rows.withColumn("_context_key_last", F.lit(now["state"].get("context_token")).cast("string"))
        run = str(uuid.uuid4())
        contexts = self.spark.read.schema(f"context_key string, messages {MESSAGES}").parquet(self.talks)
        engine = replace(self.engine, contexts=contexts)
        done = engine.run(engine.graphs[now["graph"]], given).withColumns({"instance_id": F.lit(instance), "run_id": F.lit(run)})
        done.select("instance_id", "run_id", F.to_json(F.struct(*done.columns)).alias("body")).write.mode("append").parquet(self.history)
        recorded = self.runs(instance).where(F.col("run_id") == run)
        if "context_write" in done.columns:
            made = recorded.select(F.from_json(F.get_json_object("body", "$.context_write"), f"struct<context_key:string,messages:{MESSAGES}>").alias("w"))
            made.where(F.col("w.context_key").isNotNull()).select("w.*").dropDuplicates(["context_key"]).write.mode("append").parquet(self.talks)
        token = recorded.select(F.max(F.get_json_object("body", "$.context_token"))).first()[0]
        state = now["state"] | ({"context_token": token} if token else {})
        self._write([(instance, now["graph"], now["run_count"] + 1, state, True, now["version"] + 1)])
        return recorded

    def runs(self, instance: str) -> DataFrame:
        return self.spark.read.parquet(self.history).where(F.col("instance_id") == instance)

    def reset(self, instance: str, keys: list[str] | None = None) -> None:
        """Clears the state, or some of its keys."""
        now = self.get(instance)
        state = {} if keys is None else {k: v for k, v in now["state"].items() if k not in keys}
        self._write([(instance, now["graph"], now["run_count"], state, True, now["version"] + 1)])

    def delete(self, instance: str) -> None:
        now = self.get(instance)
        self._write([(instance, now["graph"], now["run_count"], now["state"], False, now["version"] + 1)])


class RunState(StatefulProcessor):
    """Counts runs and keeps the last item; a null command is a run, ``reset`` clears the state."""

    def __init__(self, key: str, item: str, order: str, command: str | None = None):
        self.key, self.item, self.order, self.command = key, item, order, command

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("run_count", StructType([StructField("n", LongType())]))
        self.last = handle.getValueState("last_item", StructType([StructField("at", StringType()), StructField("item", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self.count.get()[0] if self.count.exists() else 0
        at, item = self.last.get() if self.last.exists() else ("", None)
        for batch in rows:
            for when, what, command in zip(batch[self.order].astype(str), batch[self.item].astype(str), batch[self.command] if self.command else [None] * len(batch), strict=True):
                if command == "reset":
                    n, at, item = 0, "", None
                    continue
                n += 1
                if when >= at:
                    at, item = when, what
        self.count.update((n,))
        self.last.update((at, item))
        yield pd.DataFrame({self.key: [key[0]], "run_count": [n], "last_item": [item]})

    def close(self) -> None:
        return


def stream_state(runs: DataFrame, key: str, item: str, order: str, command: str | None = None) -> DataFrame:
    """State by instance over a stream, told after each batch (output mode update). It needs the RocksDB state store."""
    kind = dict(runs.dtypes)[key]
    return runs.groupBy(key).transformWithStateInPandas(RunState(key, item, order, command), f"{key} {kind}, run_count long, last_item string", "Update", "None")


#: Operations on an instance's keyed state: instance, name (null: all), operation, value (text; of ``update`` a JSON object).
STATE_OPS = ("set", "increment", "append", "update", "clear")


def keyed_state(ops: DataFrame, key: str, order: Column) -> DataFrame:
    """The state after all operations, a row for each instance and name that was not cleared since: ``counter`` (sum of
    increments), ``items`` (what was appended, in order), ``fields`` (the last value of each field), ``value`` (the last set).

    ``ops`` has ``key``, ``name``, ``op``, ``value``. Clears are found by partial maxima and joined back by instance; counters
    are summed before they are shuffled. A list is one value, as in the state that it stands for."""
    rows = ops.withColumn("at", order)
    clears = rows.where(F.col("op") == "clear")
    by_name = clears.where(F.col("name").isNotNull()).groupBy(key, "name").agg(F.max("at").alias("c1"))
    by_all = clears.where(F.col("name").isNull()).groupBy(key).agg(F.max("at").alias("c2"))
    live = rows.where(F.col("op") != "clear").join(by_name, [key, "name"], "left").join(by_all, [key], "left")
    live = live.where(F.coalesce(F.col("at") > F.col("c1"), F.lit(True)) & F.coalesce(F.col("at") > F.col("c2"), F.lit(True)))
    is_ = lambda op, then: F.when(F.col("op") == op, then)
    fields = live.where(F.col("op") == "update").select(key, "name", "at", F.explode(F.from_json("value", "map<string,string>")).alias("field", "x"))
    fields = fields.groupBy(key, "name", "field").agg(F.max_by("x", "at").alias("x")).groupBy(key, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "x")))).alias("fields"))
    listed = F.array_sort(F.collect_list(is_("append", F.struct("at", "value"))))
    told = live.groupBy(key, "name").agg(F.sum(is_("increment", F.col("value").cast("long"))).alias("counter"), listed.alias("l"), F.max(is_("set", F.struct("at", "value"))).alias("s"))
    return told.join(fields, [key, "name"], "left").select(key, "name", "counter", F.transform("l", lambda x: x["value"]).alias("items"), "fields", F.col("s.value").alias("value"))


class KeyedState(StatefulProcessor):
    """The same on a stream: state by name, as JSON, that can expire ``ttl`` milliseconds after its last change. After each
    operation its name and state are told; a clear tells null."""

    def __init__(self, key: str, ttl: int | None = None):
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = lambda n: StructType([StructField(n, StringType())])
        self.state = handle.getMapState("by_name", text("name"), text("body"), self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        for batch in rows:
            out = []
            for name, op, value in zip(batch["name"], batch["op"], batch["value"], strict=True):
                if op == "clear":
                    for gone in [(name,)] if isinstance(name, str) else list(self.state.keys()):
                        if self.state.containsKey(gone):
                            self.state.removeKey(gone)
                    out.append((key[0], name, None))
                    continue
                now = json.loads(self.state.getValue((name,))[0]) if self.state.containsKey((name,)) else {}
                if op == "increment":
                    now["counter"] = now.get("counter", 0) + int(value)
                elif op == "append":
                    now["items"] = [*now.get("items", []), value]
                elif op == "update":
                    now["fields"] = now.get("fields", {}) | json.loads(value)
                else:
                    now["value"] = value
                body = json.dumps(now, sort_keys=True)
                self.state.updateValue((name,), (body,))
                out.append((key[0], name, body))
            yield pd.DataFrame(out, columns=[self.key, "name", "state"])

    def close(self) -> None:
        return


def stream_keyed_state(ops: DataFrame, key: str, ttl: int | None = None) -> DataFrame:
    """Keyed state by instance over a stream of operations (``key``, ``name``, ``op``, ``value``), told after each."""
    kind = dict(ops.dtypes)[key]
    mode = "ProcessingTime" if ttl is not None else "None"
    return ops.groupBy(key).transformWithStateInPandas(KeyedState(key, ttl), f"{key} {kind}, name string, state string", "Update", mode)


def run_stream(engine: Engine, graph: Graph, rows: DataFrame, path: str, checkpoint: str, **trigger: Any) -> Any:
    """A graph over a stream of inputs, its outputs appended as Parquet."""
    sink = engine.run(graph, rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return sink.trigger(**(trigger or {"availableNow": True})).start(path)


def windowed(events: DataFrame, at: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts by tumbling windows, with a watermark for late rows."""
    timed = events.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width), *keys).agg(F.count(F.lit(1)).alias("n"))
