"""Chat nodes, the contexts that they continue, and the providers that answer.

A table of contexts (context_key, messages) is read by a join on the key; what a chat makes is returned as ``write`` and
merged by key, so a task that runs twice writes once. The mock provider is an expression. Other providers are asked once for
each distinct request of a run; the answers are written before they are used, since a task may run twice and answers cost."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversation as talk
from ..functions import text as texts
from ..sources.shared import written
from .base import Built, Call, NodeType, Value

#: What providers can do (context caching, prompt caching, longest context).
PROVIDERS = {
    "bedrock": (True, True, 100000),
    "anthropic": (True, True, 100000),
    "openai": (False, False, 32000),
    "ollama": (False, False, 4000),
    "mock": (False, False, 1000),
}

MESSAGES = "array<struct<role:string,content:string>>"


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROVIDERS.items()], "provider string, context_caching boolean, prompt_caching boolean, max_context_length int")


def _posted(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def local_provider(url: str, model: str, temperature: float = 0.7, timeout: float = 1200) -> Callable[[str], str]:
    """A caller of a local model server's generate endpoint; anything but success becomes an error text."""

    def ask(prompt: str) -> str:
        try:
            body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature}}
            return str(_posted(url, body, {}, timeout).get("response", "No response")).strip()
        except urllib.error.HTTPError as e:
            return f"Ollama error: HTTP {e.code}"
        except (OSError, ValueError, AttributeError) as e:  # no connection, or a reply that isn't a JSON object
            return f"Error: {e}"

    return ask


def hosted_provider(url: str, model: str, api_key: str, temperature: float = 0.7, max_tokens: int = 4000, timeout: float = 600) -> Callable[[str], str]:
    """A caller of a hosted messages endpoint, which wants the system prompt apart from the messages. It is asked with
    JSON of both, as ``talk.split_request`` makes it, and answers with the texts of the reply's content joined."""

    def ask(request: str) -> str:
        try:
            told = json.loads(request)
            body = {"model": model, "max_tokens": max_tokens, "temperature": temperature, "system": told["system"], "messages": told["messages"]}
            found = _posted(url, body, {"x-api-key": api_key, "anthropic-version": "2023-06-01"}, timeout)
            return "".join(part.get("text", str(part)) for part in found["content"])
        except (OSError, ValueError, KeyError, AttributeError, TypeError) as e:
            return f"Error: Anthropic API error: {e}"

    ask.wants_messages = True
    return ask


def answered(requests: Column, ask: Callable[[str], str]) -> Column:
    """The provider's answer to each request; null is not asked. Not deterministic, so Spark doesn't repeat it at will."""

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = {p: ask(p) for p in batch.dropna().unique()}
            yield batch.map(known.get)

    return F.pandas_udf(answers, "string").asNondeterministic()(requests)


def with_answers(frame: DataFrame, request: str, answer: str, ask: Callable[[str], str]) -> DataFrame:
    """``frame`` with a column ``answer`` to its column ``request``: distinct requests are asked once and written, then
    joined back. On a stream, where nothing can be joined back, equal requests of a batch are asked once."""
    if frame.isStreaming:
        return frame.withColumn(answer, answered(F.col(request), ask))
    asked = frame.select(F.col(request).alias(f"{request}_")).where(F.col(f"{request}_").isNotNull()).distinct()
    told = written(asked.withColumn(answer, answered(F.col(f"{request}_"), ask)))
    return frame.join(told, F.col(request) == F.col(f"{request}_"), "left").drop(f"{request}_")


def merged_contexts(contexts: DataFrame, writes: DataFrame, keys: str = "context_key") -> DataFrame:
    """Contexts after some writes (rows of context_key and messages): a written key replaces what was there, and of equal
    keys one row is kept. Aggregated with partial maxima, so a hot key costs a row a task."""
    rank = lambda df, k: df.select(keys, F.struct(F.lit(k).alias("new"), F.size("messages").alias("n"), F.col("messages").alias("m")).alias("w"))
    rows = rank(contexts, 0).unionByName(rank(writes, 1)).where(F.col(keys).isNotNull())
    return rows.groupBy(keys).agg(F.max("w").alias("w")).select(keys, F.col("w.m").alias("messages"))


def acted(requests: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their context action carried out, and the contexts that this makes.

    ``requests`` has ``action`` (``new``, ``continue``, ``rewind`` or null), ``context_id``, ``conversation_id`` and
    ``rewind_steps``. They get the inputs ``_context`` (continue: the context named; rewind: one without the last
    exchanges, under the key of what is left; null where the context isn't there) and ``_conversation_id`` (new)."""
    known = contexts.select(F.col("context_key").alias("acted_key"), F.col("messages").alias("acted_messages")).dropDuplicates(["acted_key"])
    asked = requests.withColumn("acted_for", F.when(F.col("action") == "rewind", F.col("context_id")))
    met = asked.join(known, F.col("acted_for") == F.col("acted_key"), "left")
    steps = F.coalesce(F.nullif(F.col("rewind_steps"), F.lit(0)), F.lit(1))
    left = F.when(F.col("acted_key").isNotNull(), talk.rewind(F.col("acted_messages"), steps))
    met = met.withColumn("acted_left", left).withColumn("acted_new", F.when(F.col("acted_left").isNotNull(), talk.context_key(F.col("acted_left"))))
    told = F.when(F.col("action") == "continue", F.col("context_id")).when(F.col("action") == "rewind", F.col("acted_new"))
    out = met.select(*[F.col(f"`{c}`") for c in requests.columns], F.nullif(told, F.lit("")).alias("_context"), F.when(F.col("action") == "new", F.nullif(F.col("conversation_id"), F.lit(""))).alias("_conversation_id"))
    writes = met.where(F.col("acted_new").isNotNull()).select(F.col("acted_new").alias("context_key"), F.col("acted_left").alias("messages")).dropDuplicates(["context_key"])
    return out, writes


def _with_reply(call: Call, frame: DataFrame, history: Column, message: Column, name: str) -> DataFrame:
    provider = call.params.get("provider", "mock")
    known = call.env.get("providers") or {}
    turn = F.size(F.filter(history, lambda m: m["role"] == "user")) + 1
    model = _either(call, "model", "mock") if "model" in call.inputs else str(call.params.get("model", "mock"))
    if "provider" in call.inputs:  # told by row: each provider is asked for its rows
        which = _either(call, "provider", "mock")
        replies = [F.when(which == "mock", talk.mock_reply(message, turn, model))]
        for k, (called, ask) in enumerate(known.items()):
            request = talk.split_request(history, message) if getattr(ask, "wants_messages", False) else talk.prompt(history, message)
            frame = frame.withColumn(f"{name}_request{k}", F.when((which == called) & message.isNotNull(), request))
            frame = with_answers(frame, f"{name}_request{k}", f"{name}_{k}", ask)
            replies.append(F.col(f"{name}_{k}"))
        unknown = F.when(~which.isin("mock", *known), F.concat(F.lit("Error: provider "), which, F.lit(" is not set up")))
        return frame.withColumn(name, F.when(message.isNotNull(), F.coalesce(*replies, unknown)))
    ask = known.get(provider)
    if provider == "mock":
        reply = talk.mock_reply(message, turn, model)
    elif ask is None:
        reply = F.lit(f"Error: provider {provider} is not set up")
    else:
        request = talk.split_request(history, message) if getattr(ask, "wants_messages", False) else talk.prompt(history, message)
        return with_answers(frame.withColumn(f"{name}_request", F.when(message.isNotNull(), request)), f"{name}_request", name, ask)
    return frame.withColumn(name, F.when(message.isNotNull(), reply))


def _either(call: Call, port: str, default: str) -> Column:
    """What is connected, else the parameter."""
    param = F.lit(str(call.params.get(port, default)))
    return F.coalesce(texts.present(call.inputs[port].text()), param) if port in call.inputs else param


def _history(call: Call, port: str, loaded: Column | None) -> Column:
    """The messages that are connected, else those of the context that is named, else the system prompt alone."""
    value = call.inputs.get(port)
    found = value.col if value is not None and value.kind == "messages" else F.from_json(value.text(), MESSAGES) if value is not None else F.lit(None).cast(MESSAGES)
    start = F.array(talk.message(F.lit("system"), _either(call, "system_prompt", "You are a helpful AI assistant.")))
    any_ = lambda m: F.coalesce(F.size(m), F.lit(0)) > 0
    return F.when(any_(found), found).otherwise(start if loaded is None else F.when(any_(loaded), loaded).otherwise(start))


def _chat(call: Call, key_port: str, ascii_only: bool = True) -> Built:
    message = texts.present(call.get("message").text())
    before = call.inputs[key_port].text() if key_port in call.inputs else F.lit(None).cast("string")
    frame, loaded, node = call.frame, None, call.node_id
    contexts = call.env.get("contexts")
    if contexts is not None and key_port in call.inputs:
        known = contexts.select(F.col("context_key").alias(f"{node}__known"), F.col("messages").cast(MESSAGES).alias(f"{node}__loaded")).dropDuplicates([f"{node}__known"])
        frame = frame.withColumn(f"{node}__asked", texts.present(before)).join(known, F.col(f"{node}__asked") == F.col(f"{node}__known"), "left")
        loaded = F.col(f"{node}__loaded")
    frame = frame.withColumn(f"{node}__history", _history(call, "messages", loaded))
    history, name = F.col(f"{node}__history"), f"{node}__reply"
    frame = _with_reply(call, frame, history, message, name)
    reply = F.col(name)
    whole = F.concat(history, F.array(talk.message(F.lit("user"), message), talk.message(F.lit("assistant"), reply)))
    ports = {
        "response": Value(F.coalesce(reply, F.lit("Error: No message provided"))),
        "messages": Value(F.when(message.isNotNull(), whole).otherwise(history), "messages"),
        "message_count": Value(F.when(message.isNotNull(), F.size(whole).cast("string")).otherwise("0")),
    }
    if key_port == "context_key":
        key = F.when(message.isNull(), F.coalesce(texts.present(before), F.lit("empty"))).otherwise(talk.context_key(whole, ascii_only))
    else:
        made = F.concat(F.lit("ctx_"), F.substring(F.sha2(F.concat_ws("\n", message, F.to_json(history)), 256), 1, 12))
        key = F.coalesce(texts.present(before), F.when(message.isNull(), "error").otherwise(made))
    ports[key_port] = Value(key)
    ports["write"] = Value(F.when(message.isNotNull(), F.struct(key.alias("context_key"), whole.alias("messages"))), "other")
    return Built(ports, frame=frame)


CHAT = [
    NodeType("smart_chat", "AI", {"message": False, "context_id": False, "messages": False}, ("response", "context_id", "messages", "message_count", "write"), lambda c: _chat(c, "context_id"), {"provider": "mock", "model": "mock", "system_prompt": "You are a helpful AI assistant.", "temperature": 0.7}, True),
    NodeType("immutable_chat", "AI", {"message": False, "context_key": False, "messages": False, "system_prompt": False, "model": False, "provider": False, "temperature": False}, ("response", "context_key", "messages", "message_count", "write"), lambda c: _chat(c, "context_key"), {"provider": "mock", "model": "mock", "system_prompt": "You are a helpful AI assistant.", "temperature": 0.7}, True),
]
