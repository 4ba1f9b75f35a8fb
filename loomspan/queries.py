"""The queries of the graph engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import conversation as talk
from .functions.text import SPACES
from .operators import chat, context
from .plans.compiler import Engine, reduced
from .plans import relations
from .plans.graph import Graph
from .sources import catalog
from .sources.shared import new_folder, written
from .sources.tables import requests, table, write_events
from .streaming import instances

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The time at which queries on expiry are asked.
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def _chain(*nodes: tuple[str, str, str, dict], name: str = "chain", start: dict | None = None) -> Graph:
    """input -> nodes, each (type, port in, port out, parameters) -> output."""
    made = {"in": ("input", {"label": "text", **(start or {})})}
    edges, last = [], "in.output"
    for k, (kind, into, out, params) in enumerate(nodes):
        made[f"n{k}"] = (kind, params)
        edges.append((last, f"n{k}.{into}"))
        last = f"n{k}.{out}"
    made["out"] = ("output", {"label": "Result"})
    return Graph.of(name, made, [*edges, (last, "out.input")])


def _on_text(spark: SparkSession, sf_dir: str, graph: Graph, col: Column | None = None, **engine: object) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("text") if col is None else col).alias("text"))
    return Engine(**engine).run(graph, rows, keep=["doc_id"]).select("doc_id", F.col("out.result").alias("result"))


def _transform(operation: str) -> Graph:
    return _chain(("text_transform", "text", "output", {"operation": operation}), name=operation)


@query("SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS result FROM documents")
def transform_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_text(spark, sf_dir, _transform("uppercase"))


@query("SELECT doc_id, lower(text) AS result FROM documents")
def transform_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_text(spark, sf_dir, _transform("lowercase"))


@query("SELECT doc_id, reverse(text) AS result FROM documents")
def transform_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_text(spark, sf_dir, _transform("reverse"))


_CHARS = " || ".join(f"chr({ord(c)})" for c in SPACES)


@query(f"SELECT doc_id, trim(text, {_CHARS}) AS result FROM documents")
def transform_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t  "), F.col("text"), F.lit("　\r\n"))
    return _on_text(spark, sf_dir, _transform("strip"), padded)


@query()
def transform_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_text(spark, sf_dir, _transform("title"))


def _filtered(spark: SparkSession, sf_dir: str, params: dict) -> DataFrame:
    graph = Graph.of(
        "filter",
        {"in": ("input", {"label": "text"}), "f": ("text_filter", params), "hit": ("output", {"label": "Matches"}), "rest": ("output", {"label": "Rest"})},
        [("in.output", "f.text"), ("f.matches", "hit.input"), ("f.filtered", "rest.input")],
    )
    done = Engine().run(graph, table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return done.select("doc_id", F.col("hit.result").alias("matches"), F.col("rest.result").alias("filtered"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z]+'), chr(10)) AS matches, regexp_replace(text, '[A-Z]+', '', 'g') AS filtered FROM documents")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"pattern": "[A-Z]+"})


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), chr(10)) AS matches, regexp_replace(text, '[\p{L}\p{N}_]+', '', 'g') AS filtered FROM documents")
def filter_regex_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"pattern": r"\w+"})


@query("SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'the' ELSE '' END AS matches, replace(text, 'the', '') AS filtered FROM documents")
def filter_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"pattern": "the", "use_regex": False})


@query("SELECT doc_id, CASE WHEN contains(text, '[') THEN '[' ELSE '' END AS matches, replace(text, '[', '') AS filtered FROM documents")
def filter_invalid_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"pattern": "["})


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(on|th)([a-z])', 2), chr(10)) AS matches FROM documents")
def filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"pattern": "(?:on|th)([a-z])"}).select("doc_id", "matches")


@query("SELECT doc_id, concat_ws(' | ', nullif(lang, ''), nullif(source, ''), n_chars::varchar) AS result FROM documents")
def concat3(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph.of(
        "concat",
        {"a": ("input", {"label": "lang"}), "b": ("input", {"label": "source"}), "c": ("input", {"label": "n_chars"}), "j": ("text_concat", {"separator": " | "}), "out": ("output", {})},
        [("a.output", "j.text1"), ("b.output", "j.text2"), ("c.output", "j.text3"), ("j.output", "out.input")],
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return Engine().run(graph, rows, keep=["doc_id"]).select("doc_id", F.col("out.result").alias("result"))


@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'by id' END, 'default') AS result FROM customer"""
)
def input_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("who"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("input_1"), F.when(k % 5 == 0, "by id").alias("in"))
    graph = Graph.of("inputs", {"in": ("input", {"label": "who", "value": "default"}), "out": ("output", {})}, [("in.output", "out.input")])
    return Engine().run(graph, rows, keep=["c_custkey"]).select("c_custkey", F.col("out.result").alias("result"))


@query(
    r"""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value::varchar WHEN 1 THEN user_id::varchar WHEN 2 THEN ' ' || user_id || ' ' WHEN 3 THEN event_type WHEN 4 THEN user_id || 'e3' ELSE '1_' || user_id END AS x FROM events)
    SELECT event_id, CASE WHEN contains(x, '.') THEN coalesce(try_cast(x AS double), 0.0) WHEN regexp_full_match(trim(x), '[+-]?\d+(_\d+)*') THEN replace(trim(x), '_', '')::double ELSE 0.0 END AS result FROM t"""
)
def input_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    x = F.when(k == 0, F.col("value").cast("string")).when(k == 1, u).when(k == 2, F.concat(F.lit(" "), u, F.lit(" "))).when(k == 3, F.col("event_type")).when(k == 4, F.concat(u, F.lit("e3"))).otherwise(F.concat(F.lit("1_"), u))
    graph = Graph.of("number", {"in": ("input", {"label": "text", "data_type": "number"}), "out": ("output", {})}, [("in.output", "out.input")])
    rows = table(spark, sf_dir, "events").select("event_id", x.alias("text"))
    return Engine().run(graph, rows, keep=["event_id"]).select("event_id", F.col("out.result").alias("result"))


def shout() -> Graph:
    """Three inputs, joined by spaces and upper-cased."""
    return Graph.of(
        "shout",
        {"a": ("input", {"value": "Potato farmers of the world"}), "b": ("input", {"value": "Unite"}), "c": ("input", {"value": "!!!"}), "j1": ("text_concat", {}), "j2": ("text_concat", {}), "up": ("text_transform", {"operation": "uppercase"}), "out": ("output", {"label": "Result"})},
        [("a.output", "j1.text1"), ("b.output", "j1.text2"), ("j1.output", "j2.text1"), ("c.output", "j2.text2"), ("j2.output", "up.text"), ("up.output", "out.input")],
    )


@query("SELECT doc_id, upper(replace(concat_ws(' ', nullif(coalesce(CASE WHEN lang <> 'fr' THEN text END, 'Potato farmers of the world'), ''), nullif(source, ''), '!!!'), 'ß', 'ss')) AS result FROM documents")
def golden_shout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("input_1"), F.col("source").alias("input_2"))
    return Engine().run(shout(), rows, keep=["doc_id"]).select("doc_id", F.col("out.result").alias("result"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, ({_WORDS})::varchar || ' !!!' AS result FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_text(spark, sf_dir, _chain(("example_processor", "text", "count_string", {"operation": "word_count"}), ("simple_text_processor", "text", "result", {"operation": "exclamation"})))


@query("SELECT doc_id, 'n=Character count: ' || length(text) AS result FROM documents")
def char_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_text(spark, sf_dir, _chain(("example_processor", "text", "processed", {"operation": "char_count", "prefix": "n="})))


@query("SELECT p_partkey, '[' || p_name || ' !!!]' AS result FROM part")
def brackets_exclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _chain(("simple_text_processor", "text", "result", {"operation": "exclamation"}), ("simple_text_processor", "text", "result", {"operation": "brackets"}), start={"label": "p_name"})
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return Engine().run(graph, rows, keep=["p_partkey"]).select("p_partkey", F.col("out.result").alias("result"))


def _extracted(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    graph = Graph.of(
        "extract",
        {"in": ("input", {"label": "props", "data_type": "json"}), "x": ("json_extract", {"key_path": path, "default_value": "none"}), "v": ("output", {}), "f": ("output", {})},
        [("in.output", "x.data"), ("x.value", "v.input"), ("x.found", "f.input")],
    )
    done = Engine().run(graph, table(spark, sf_dir, "events").select("event_id", "props"), keep=["event_id"])
    return done.select("event_id", F.col("v.result").alias("value"), F.col("f.result.success").alias("success"), F.col("f.result.reason").alias("reason"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS value, json_extract(props, '$.k') IS NOT NULL AS success, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'key_not_found: k' END AS reason FROM events")
def json_extract_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "k")


@query("SELECT event_id, 'none' AS value, false AS success, 'key_not_found: nope' AS reason FROM events")
def json_extract_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "nope.deeper")


@query("SELECT event_id, json_merge_patch(props::json, json_object('meta', json_object('src', event_type)))::varchar AS result, true AS success FROM events")
def json_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph.of(
        "replace",
        {"in": ("input", {"label": "props", "data_type": "json"}), "v": ("input", {"label": "event_type"}), "r": ("json_replace", {"key_path": "meta.src"}), "out": ("output", {}), "s": ("output", {})},
        [("in.output", "r.data"), ("v.output", "r.value"), ("r.text", "out.input"), ("r.success", "s.input")],
    )
    done = Engine().run(graph, table(spark, sf_dir, "events").select("event_id", "props", "event_type"), keep=["event_id"])
    return done.select("event_id", F.col("out.result").alias("result"), F.col("s.result.success").alias("success"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's messages in order. Aggregated by conversation: one conversation is one row."""
    rows = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", talk.message(F.col("role"), F.col("text")).alias("m"))))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["m"]).alias("messages"))


def _escaped(text: str) -> str:
    """SQL for a text inside JSON that is plain ASCII: what isn't is told by its UTF-16 units."""
    unit = lambda x: f"'\\u' || printf('%04x', {x})"
    named = " ".join(f"WHEN {ord(c)} THEN '\\{to}'" for c, to in zip('"\\\n\r\t\b\f', '"\\nrtbf', strict=True))
    each = f"CASE unicode(c) {named} ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN {unit('unicode(c)')} ELSE {unit('55296 + ((unicode(c) - 65536) >> 10)')} || {unit('56320 + ((unicode(c) - 65536) & 1023)')} END END"
    return f"array_to_string(list_transform(string_split(coalesce({text}, ''), ''), lambda c: {each}), '')"


def _said(role: str, text: str) -> str:
    """SQL for a message in the JSON of which keys are made; ``role`` and ``text`` are SQL."""
    return f"""'{{"content":"' || {_escaped(text)} || '","role":"' || {_escaped(role)} || '"}}'"""


def _key(messages: str) -> str:
    return f"substr(sha256('[' || {messages} || ']'), 1, 16)"


#: SQL for the messages of a conversation as JSON.
_MESSAGES = f"(SELECT conv_id, turn, role, text, {_said('role', 'text')} AS m FROM conversations)"
_SO_FAR = "array_to_string(list(m ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn), ',')"


@query(f"SELECT conv_id, turn, {_key(_SO_FAR)} AS context_key FROM {_MESSAGES}")
def context_prefix_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "conversations")
    messages = F.collect_list(talk.message(F.col("role"), F.col("text"))).over(so_far)
    return rows.withColumn("messages", messages).select("conv_id", "turn", talk.context_key(F.col("messages")).alias("context_key"))


@query(
    f"""WITH m AS (SELECT conv_id, {_key("string_agg(m, ',' ORDER BY turn)")} AS context_key, count(*) AS n_messages FROM {_MESSAGES} GROUP BY conv_id)
    SELECT context_key, count(*) AS n_conversations, min(n_messages) AS n_messages FROM m GROUP BY context_key"""
)
def context_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _talks(spark, sf_dir).select(talk.context_key(F.col("messages")).alias("context_key"), F.size("messages").cast("long").alias("n_messages"))
    return keyed.groupBy("context_key").agg(F.count(F.lit(1)).alias("n_conversations"), F.min("n_messages").alias("n_messages"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, turn, '[MOCK DEMO] Turn ' || n || ' response to: ' || text AS response FROM t WHERE role = 'user'"""
)
def chat_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.count_if(F.col("role") == "user").over(so_far))
    return rows.where(F.col("role") == "user").select("conv_id", "turn", talk.mock_reply(F.col("text"), F.col("n"), "demo").alias("response"))


@query(
    """SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Assistant:' AS prompt FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id"""
)
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", talk.prompt(F.col("messages")).alias("prompt"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'system') AS system_prompt, count(*) FILTER (WHERE role <> 'system') AS n_others FROM conversations GROUP BY conv_id")
def chat_system_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = F.size(F.filter("messages", lambda m: m["role"] != "system")).cast("long")
    return _talks(spark, sf_dir).select("conv_id", talk.last_system(F.col("messages")).alias("system_prompt"), others.alias("n_others"))


@query(
    """WITH l AS (SELECT conv_id, list({'content': coalesce(text, ''), 'role': coalesce(role, '')} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
    SELECT conv_id, to_json(CASE WHEN 4 < len(m) THEN m[1:len(m) - 4] ELSE m END)::varchar AS messages FROM l"""
)
def context_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", talk.canonical(talk.rewind(F.col("messages"), F.lit(2)), ascii_only=False).alias("messages"))


@query("SELECT conv_id, count(*)::varchar AS message_count FROM conversations GROUP BY conv_id")
def message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("message_count"))


def _continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talks(spark, sf_dir).select("conv_id", F.to_json("messages").alias("history"))
    graph = Graph.of(
        "continue",
        {"h": ("input", {"label": "history"}), "q": ("input", {"value": "go on"}), "chat": ("immutable_chat", {"provider": "mock", "model": "demo"}), "r": ("output", {}), "n": ("output", {}), "m": ("output", {})},
        [("h.output", "chat.messages"), ("q.output", "chat.message"), ("chat.response", "r.input"), ("chat.message_count", "n.input"), ("chat.messages", "m.input")],
    )
    return Engine().run(graph, rows, keep=["conv_id"])


@query(
    f"""WITH l AS (SELECT conv_id, string_agg(m, ',' ORDER BY turn) AS m, count(*) AS size, count(*) FILTER (WHERE role = 'user') + 1 AS n FROM {_MESSAGES} GROUP BY conv_id),
    r AS (SELECT conv_id, '[MOCK DEMO] Turn ' || n || ' response to: go on' AS response, m, size FROM l)
    SELECT conv_id, response, (size + 2)::varchar AS message_count, {_key("m || ',' || " + _said("'user'", "'go on'") + " || ',' || " + _said("'assistant'", "response"))} AS context_key FROM r"""
)
def chat_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more turn of every conversation by the chat node."""
    return _continued(spark, sf_dir).select("conv_id", F.col("r.result").alias("response"), F.col("n.result").alias("message_count"), F.col("context_token").alias("context_key"))


def _asked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the first and the last text."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))


def _chat_graph(kind: str = "immutable_chat", port: str = "context_key") -> Graph:
    return Graph.of(
        "talk",
        {"m": ("input", {"label": "message"}), "k": ("input", {"label": "_context"}), "chat": (kind, {"model": "demo"}), "r": ("output", {}), "n": ("output", {})},
        [("m.output", "chat.message"), ("k.output", f"chat.{port}"), ("chat.response", "r.input"), ("chat.message_count", "n.input")],
    )


def _turn(rows: DataFrame, contexts: DataFrame | None, message: str, graph: Graph | None = None) -> DataFrame:
    """One turn of every conversation, by a graph whose chat loads the context that the row names."""
    given = rows.withColumn("message", F.col(message))
    done = Engine(contexts=contexts).run(graph or _chat_graph(), given)
    return done.select(*rows.columns, F.col("r.result").alias("response"), F.col("n.result").alias("message_count"), F.col("context_token").alias("context_key"), "context_write")


_START = _said("'system'", "'You are a helpful AI assistant.'")
_TWO_TURNS = f"""f AS (SELECT conv_id, arg_min(text, turn) AS q1, arg_max(text, turn) AS q2 FROM conversations GROUP BY conv_id),
    a AS (SELECT *, '[MOCK DEMO] Turn 1 response to: ' || q1 AS r1 FROM f), b AS (SELECT *, {_START} || ',' || {_said("'user'", "q1")} || ',' || {_said("'assistant'", "r1")} AS m1 FROM a)"""


@query(
    f"""WITH {_TWO_TURNS}, c AS (SELECT *, '[MOCK DEMO] Turn 2 response to: ' || q2 AS r2 FROM b)
    SELECT conv_id, r2 AS response, '5' AS message_count, {_key("m1 || ',' || " + _said("'user'", "q2") + " || ',' || " + _said("'assistant'", "r2"))} AS context_key FROM c WHERE q1 <> '' AND q2 <> ''
    UNION ALL SELECT conv_id, 'Error: No message provided', '0', {_key("m1")} FROM b WHERE q1 <> '' AND coalesce(q2, '') = ''"""
)
def chat_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a chat graph: the second is given the first one's key alone, and loads its messages from the contexts
    that the first run wrote. Conversations whose first text is empty have no first turn."""
    first = written(_turn(_asked_twice(spark, sf_dir).where("first <> ''").withColumn("_context", F.lit(None).cast("string")), None, "first"))
    contexts = first.select("context_write.*").dropDuplicates(["context_key"])
    return _turn(first.select("conv_id", "last", F.col("context_key").alias("_context")), contexts, "last").select("conv_id", "response", "message_count", "context_key")


@query(
    f"""WITH s AS (SELECT conv_id, list(m ORDER BY turn) AS m, list(role ORDER BY turn) AS roles, conv_id % 3 AS act FROM {_MESSAGES} GROUP BY conv_id),
    t AS (SELECT conv_id, act, CASE WHEN act = 2 THEN [] WHEN act = 1 AND len(m) > 2 THEN m[1:len(m) - 2] ELSE m END AS m, CASE WHEN act = 1 AND len(m) > 2 THEN roles[1:len(roles) - 2] ELSE roles END AS roles FROM s),
    u AS (SELECT conv_id, CASE WHEN act = 2 THEN {_START} ELSE array_to_string(m, ',') END AS m, CASE WHEN act = 2 THEN 1 ELSE len(m) END AS size,
      '[MOCK DEMO] Turn ' || (CASE WHEN act = 2 THEN 0 ELSE len(list_filter(roles, lambda r: r = 'user')) END + 1) || ' response to: and now' AS response FROM t)
    SELECT conv_id, response, (size + 2)::varchar AS message_count, {_key("m || ',' || " + _said("'user'", "'and now'") + " || ',' || " + _said("'assistant'", "response"))} AS context_key FROM u"""
)
def chat_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a stored context; a third of them is continued, a third rewound by a turn first, a third begun
    anew."""
    stored = written(_talks(spark, sf_dir).select("conv_id", talk.context_key(F.col("messages")).alias("context_key"), "messages"))
    act = F.element_at(F.array(*map(F.lit, ("continue", "rewind", "new"))), (F.col("conv_id") % 3 + 1).cast("int"))
    asked = stored.select("conv_id", act.alias("action"), F.col("context_key").alias("context_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit(1).alias("rewind_steps"), F.lit("and now").alias("question"))
    contexts = stored.select("context_key", "messages")
    ready, made = chat.acted(asked, contexts)
    done = _turn(ready.select("conv_id", "question", "_context"), chat.merged_contexts(contexts, made), "question")
    return done.select("conv_id", "response", "message_count", "context_key")


@query(
    f"""WITH {_TWO_TURNS} SELECT conv_id, r1 AS content, 'completed' AS status, 7::bigint AS n_events FROM b WHERE q1 <> ''
    UNION ALL SELECT conv_id, 'Error: No message provided', 'completed', 7::bigint FROM b WHERE coalesce(q1, '') = ''"""
)
def chat_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client shows of the events of a chat on each conversation's first text."""
    rows = _asked_twice(spark, sf_dir).select("conv_id", F.col("first").alias("message"))
    events = Engine().events(_chat_graph(), rows, ["conv_id"])
    return reduced(events, "conv_id").select("conv_id", "content", "status", "n_events")


@query(
    f"""WITH s AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN ts + to_hours(((event_id % 4) * 100)::bigint) END AS expires FROM events WHERE event_id % 3 <> 0)
    SELECT e.event_id, CASE WHEN s.event_id IS NOT NULL AND coalesce(s.expires >= TIMESTAMP '{NOW}', true) THEN s.event_type ELSE 'gone' END AS context_data,
      CASE WHEN s.event_id IS NOT NULL AND coalesce(s.expires >= TIMESTAMP '{NOW}', true) THEN 'true' ELSE 'false' END AS found,
      CASE WHEN s.event_id IS NULL THEN '0' WHEN s.expires < TIMESTAMP '{NOW}' THEN 'expired' ELSE round(date_diff('microsecond', s.ts, TIMESTAMP '{NOW}') / 3600000000.0, 1)::varchar END AS age_hours
    FROM events e LEFT JOIN s USING (event_id)"""
)
def context_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's context is asked for, where two of three were stored and some have expired."""
    events = table(spark, sf_dir, "events")
    hours = (F.col("event_id") % 4) * 100
    store = events.where(F.col("event_id") % 3 != 0).select(F.col("event_id").cast("string").alias("context_key"), F.col("event_type").alias("context_data"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), context.expiry(F.col("ts"), hours).alias("expires_at"))
    graph = Graph.of(
        "ask",
        {"k": ("input", {"label": "event_id"}), "get": ("context_retrieve", {"default_value": "gone", "cleanup_expired": False}), "d": ("output", {}), "f": ("output", {}), "a": ("output", {})},
        [("k.output", "get.context_key"), ("get.context_data", "d.input"), ("get.found", "f.input"), ("get.age_hours", "a.input")],
    )
    done = Engine(store=store, now=NOW).run(graph, events.select("event_id"))
    return done.select("event_id", F.col("d.result").alias("context_data"), F.col("f.result").alias("found"), F.col("a.result").alias("age_hours"))


def _event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("_", F.lit("ctx"), F.col("event_type"), F.col("event_id").cast("string"))
    hours = (F.col("event_id") % 5) * 60
    return table(spark, sf_dir, "events").select(key.alias("context_key"), F.col("props").alias("context_data"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), context.expiry(F.col("ts"), hours).alias("expires_at"))


@query(
    f"""WITH s AS (SELECT 'ctx_' || event_type || '_' || event_id AS context_key, props, ts, CASE WHEN event_id % 5 > 0 THEN ts + to_hours(((event_id % 5) * 60)::bigint) END AS expires FROM events)
    SELECT context_key, round(date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 3600000000.0, 1)::varchar AS age_hours, false AS is_expired, length(props) AS data_size
    FROM s WHERE contains(context_key, 'purchase') AND (expires IS NULL OR expires > TIMESTAMP '{NOW}') ORDER BY context_key LIMIT 50"""
)
def context_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 keys that hold a word: the listing is a page."""
    return context.listed(_event_store(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), "purchase", 50).select("context_key", "age_hours", "is_expired", F.col("data_size").cast("long").alias("data_size"))


def _upserted(spark: SparkSession, sf_dir: str, overwrite: bool) -> DataFrame:
    events = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string").alias("context_key")
    never = F.lit(None).cast("timestamp_ntz")
    first = events.where(F.col("event_id") % 2 == 0).select(key, F.col("event_type").alias("context_data"), F.col("ts").alias("written_at"), never.alias("expires_at"))
    store = context.stored(spark.createDataFrame([], context.STORE), first, overwrite)
    then = events.where(F.col("event_id") % 2 == 1).select(key, F.col("event_type").alias("context_data"), F.col("ts").alias("written_at"), never.alias("expires_at"))
    return context.stored(store, then, overwrite).select("context_key", "context_data", "created_at", "updated_at")


@query(
    """WITH w AS (SELECT user_id::varchar AS k, event_type AS d, ts, event_id % 2 AS later FROM events)
    SELECT k AS context_key, arg_max(d, (later, ts, d)) AS context_data, min(ts) AS created_at, max((later, ts, d))[2] AS updated_at FROM w GROUP BY k"""
)
def context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, True)


@query(
    """WITH w AS (SELECT user_id::varchar AS k, event_type AS d, ts, event_id % 2 AS later FROM events)
    SELECT k AS context_key, arg_min(d, (later, ts, d)) AS context_data, min(ts) AS created_at, min((later, ts, d))[2] AS updated_at FROM w GROUP BY k"""
)
def context_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, False)


@query(
    f"""WITH k AS (SELECT turn, {_key(_SO_FAR)} AS context_key FROM {_MESSAGES})
    SELECT context_key, min(turn) AS turn FROM k WHERE context_key NOT IN (SELECT context_key FROM k WHERE turn % 2 = 0) GROUP BY context_key"""
)
def context_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the conversations' odd turns that the even turns' keys don't hold: each is written once."""
    keys = context_prefix_key(spark, sf_dir).groupBy("context_key").agg(F.min("turn").alias("turn"), F.max((F.col("turn") % 2 == 0).cast("int")).alias("known"))
    return context.insert_absent(keys.where("known = 1"), keys.select("context_key", "turn"))


def _tokens(rows: DataFrame) -> DataFrame:
    graph = Graph.of("talk", {"m": ("input", {"label": "message"}), "chat": ("immutable_chat", {}), "r": ("output", {})}, [("m.output", "chat.message"), ("chat.response", "r.input")])
    done = Engine().run(graph, rows, keep=["conv_id"])
    return done.select("conv_id", F.col("r.result").alias("response"), F.col("context_token").alias("context_key"))


@query(
    f"""WITH t AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations GROUP BY conv_id), a AS (SELECT *, '[MOCK MOCK] Turn 1 response to: ' || q AS r FROM t)
    SELECT conv_id, CASE WHEN q <> '' THEN r ELSE 'Error: No message provided' END AS response, CASE WHEN q <> '' THEN {_key(_START + " || ',' || " + _said("'user'", "q") + " || ',' || " + _said("'assistant'", "r"))} ELSE 'empty' END AS context_key FROM a"""
)
def context_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that a chat graph hands on for the last message of every conversation, whatever is in it."""
    return _tokens(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("message")))


#: Earlier names of queries whose keys were not those of JSON in ASCII then.
for _name, _then in (("context_prefix_key", "context_prefix_key_escaped"), ("context_dedupe", "context_dedupe_escaped"), ("chat_continue", "chat_continue_escaped"), ("context_token", "context_token_all")):
    _QUERIES[_then], _SQL[_then] = _QUERIES[_name], _SQL[_name]


@query("SELECT c_custkey, 'k_' || substr(sha256(c_name), 1, 12) AS hash_key FROM customer")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph.of("keys", {"in": ("input", {"label": "c_name"}), "k": ("generate_random_key", {"prefix": "k_", "key_length": 12}), "out": ("output", {})}, [("in.output", "k.seed_data"), ("k.hash_key", "out.input")])
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return Engine().run(graph, rows, keep=["c_custkey"]).select("c_custkey", F.col("out.result").alias("hash_key"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_count FROM events")
def instance_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances.run_counts(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "run_count")


@query("SELECT user_id, count(*) AS run_count, sum(length(event_type))::bigint AS counter, arg_max(event_type, (ts, event_id)) AS last_item FROM events GROUP BY user_id")
def instance_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances.totals(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), F.length("event_type"), F.struct("ts", "event_id"))


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def instance_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instances.with_previous(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return rows.select("event_id", F.col("_context_key_event_type").alias("previous"))


#: A row of the parts table stands for a graph node, whose edge leads to the node of twice its number.
_EDGES_SQL = "SELECT p_brand AS graph, p_partkey AS source, p_partkey * 2 AS target FROM part"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("node_id"), F.lit("input").alias("node_type"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target"))


@query(f"WITH e AS ({_EDGES_SQL}) SELECT source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = e.target)")
def graph_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose target is no node."""
    return relations.dangling(_edges(spark, sf_dir), _nodes(spark, sf_dir), within=()).select("source", "target")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT graph, target, count(*) AS in_degree FROM e GROUP BY graph, target")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.in_degrees(_edges(spark, sf_dir))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def graph_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (part to supplier) that are listed more than once."""
    return relations.repeated(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"))


@query("SELECT p_brand AS graph, p_partkey AS node_id, 'input_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey::varchar) AS ordinal_key FROM part")
def graph_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each input node among its graph's, by id as text."""
    return relations.input_keys(_nodes(spark, sf_dir)).withColumn("node_id", F.col("node_id").cast("long"))


@query("SELECT p_type AS category, p_partkey AS member, count(*) OVER (PARTITION BY p_type) AS n FROM part")
def nodes_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each category, a row each, with the category's size."""
    return relations.by_category(table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("member")))


def _failing_graph() -> Graph:
    """A graph whose input may have no value, which the next node needs."""
    return Graph.of("fails", {"in": ("input", {"label": "text", "value": None}), "up": ("text_transform", {"operation": "uppercase"}), "out": ("output", {})}, [("in.output", "up.text"), ("up.output", "out.input")])


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    return Engine().run(_failing_graph(), rows, keep=["doc_id"])


@query(
    """SELECT doc_id, CASE WHEN coalesce(lang <> 'de', false) THEN 'completed' ELSE 'failed' END AS status, 'completed' AS in_status,
    CASE WHEN coalesce(lang <> 'de', false) THEN 'completed' ELSE 'failed' END AS up_status, CASE WHEN coalesce(lang <> 'de', false) THEN 'completed' ELSE 'pending' END AS out_status FROM documents"""
)
def node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("node_status")
    return _failing(spark, sf_dir).select("doc_id", "status", *[F.element_at(state, n).alias(f"{n}_status") for n in ("in", "up", "out")])


@query(
    """SELECT doc_id, CASE WHEN lang <> 'de' THEN upper(replace(text, 'ß', 'ss')) END AS result,
    CASE WHEN coalesce(lang <> 'de', false) THEN NULL ELSE 'Node up failed: Invalid inputs for node up. Missing required inputs: [''text'']' END AS error FROM documents"""
)
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failing(spark, sf_dir).select("doc_id", F.col("out.result").alias("result"), F.map_values("errors")[0].alias("error"))


@query(
    """SELECT doc_id, position, type, node_id FROM documents, (VALUES (0, 'node_complete', 'in'), (1, 'node_complete', 'n0'), (2, 'node_complete', 'out'), (3, 'execution_complete', NULL)) AS e(position, type, node_id)"""
)
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Engine().events(_transform("uppercase"), rows, ["doc_id"]).select("doc_id", "position", "type", "node_id")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def execution_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a listing."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, '\"' || upper(replace(text, 'ß', 'ss')) || '\"' AS result FROM documents")
def subgraph_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _transform("uppercase")
    outer = Graph.of(
        "outer",
        {"in": ("input", {"label": "text"}), "sub": ("subgraph", {"graph": "uppercase", "input_mapping": '{"body": "text"}', "output_mapping": {"out": "loud"}}), "q": ("simple_text_processor", {"operation": "quotes"}), "out": ("output", {})},
        [("in.output", "sub.body"), ("sub.loud", "q.text"), ("q.result", "out.input")],
    )
    return _on_text(spark, sf_dir, outer, graphs={"uppercase": inner})


@query("SELECT doc_id, upper(replace(concat_ws(' ', nullif(text, ''), 'Unite', '!!!'), 'ß', 'ss')) AS result FROM documents")
def dynamic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = Graph.of("outer", {"in": ("input", {"label": "text"}), "sub": ("dynamic_graph", {"graph": "shout"}), "out": ("output", {})}, [("in.output", "sub.input_1"), ("sub.result", "out.input")])
    return _on_text(spark, sf_dir, outer, graphs={"shout": shout()})


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def object_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the hash of their content: the first, and how many."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE level(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p.p_partkey, l.depth + 1 FROM level l JOIN part p ON p.p_partkey = l.node * 2)
    SELECT node, max(depth)::int AS depth FROM level GROUP BY node"""
)
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every node from the start of its chain, where edges lead from a number to its double."""
    nodes = _nodes(spark, sf_dir)
    return relations.depths(nodes, _edges(spark, sf_dir), nodes.where(F.col("node_id") % 2 == 1), within=())


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@query(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, label FROM embeddings, q WHERE vec_id <> 0 AND label < 5 ORDER BY list_cosine_similarity(embedding::double[], e::double[]) DESC, vec_id LIMIT 10"""
)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like vector 0 by cosine, of some labels: a top-k search for one query."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") == 0).select(F.col("embedding").alias("e"))
    near = rows.where((F.col("vec_id") != 0) & (F.col("label") < 5)).crossJoin(F.broadcast(asked))  # one row
    return near.withColumn("score", _cosine(F.col("embedding"), F.col("e"))).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "label")


@query(
    """WITH ops AS (SELECT user_id, event_id, (ts, event_id) AS o, event_type, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'increment' WHEN event_id % 3 = 1 THEN 'append' ELSE 'update' END AS op, CASE WHEN event_id % 97 = 0 AND event_id % 2 = 0 THEN NULL ELSE 'n' || (event_id % 2) END AS name FROM events),
    c AS (SELECT user_id, name, max(o) AS c FROM ops WHERE op = 'clear' GROUP BY ALL),
    l AS (SELECT x.* FROM ops x WHERE op <> 'clear' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = x.user_id AND (c.name IS NULL OR c.name = x.name) AND c.c > x.o)),
    d AS (SELECT user_id, name, event_type, max(o)[2] AS v FROM l WHERE op = 'update' GROUP BY ALL),
    e AS (SELECT user_id, name, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS fields FROM d GROUP BY ALL)
    SELECT user_id, name, coalesce(sum(length(event_type)) FILTER (WHERE op = 'increment'), 0)::bigint AS counter, coalesce(string_agg(event_type, ',' ORDER BY o) FILTER (WHERE op = 'append'), '') AS items, fields
    FROM l LEFT JOIN e USING (user_id, name) GROUP BY user_id, name, fields"""
)
def instance_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, lists and dicts of each instance after all events, some of which clear a name or all."""
    k = F.col("event_id")
    op = F.when(k % 97 == 0, "clear").when(k % 3 == 0, "increment").when(k % 3 == 1, "append").otherwise("update")
    name = F.when((k % 97 == 0) & (k % 2 == 0), None).otherwise(F.concat(F.lit("n"), (k % 2).cast("string")))
    value = F.when(op == "increment", F.length("event_type").cast("string")).when(op == "update", F.to_json(F.create_map("event_type", k.cast("string")))).otherwise(F.col("event_type"))
    ops = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", op.alias("op"), name.alias("name"), value.alias("value"))
    state = instances.keyed_state(ops, "user_id", F.struct("ts", "event_id"))
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return state.select("user_id", "name", F.coalesce("counter", F.lit(0)).cast("long").alias("counter"), F.array_join("items", ",").alias("items"), fields.alias("fields"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND json_extract(props, '$.k')::varchar = '7'")
def object_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a type whose metadata has a value."""
    rows = catalog.matching(table(spark, sf_dir, "events"), {"event_type": "click"}, "props", {"k": 7})
    return rows.select("event_id", "event_type")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one table lacks of another."""
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id, 'Result' AS name, upper(replace(text, 'ß', 'ss')) AS result FROM documents")
def output_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs of recorded executions under the names that their nodes show."""
    graph = _transform("uppercase")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = Engine().run(graph, rows, keep=["doc_id"]).select("doc_id", F.lit(graph.name).alias("graph"), F.create_map(F.lit("out"), F.col("out.result")).alias("outputs"))
    return catalog.named_outputs(done, graph.node_rows(spark)).select("doc_id", "name", "result")


_COSINE = "list_cosine_similarity(embedding::double[], e::double[])"


@query(
    f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id, label FROM embeddings, q WHERE vec_id <> 0 AND label < 5 ORDER BY {_COSINE} DESC, vec_id LIMIT 10)
    SELECT vec_id, label, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM near LEFT JOIN documents d ON d.doc_id = vec_id LEFT JOIN labels l ON l.doc_id = vec_id"""
)
def search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a vector search with the metadata and annotations of their objects."""
    hits = semantic_topk(spark, sf_dir)
    objects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    met = F.broadcast(hits).join(objects, "vec_id", "left").join(notes, "vec_id", "left")  # ten hits
    return met.select("vec_id", "label", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(
    f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {_COSINE} AS near, (contains(text, 'the')::int + contains(text, 'and')::int + contains(text, 'of')::int) / 3.0 AS words
      FROM embeddings JOIN documents ON doc_id = vec_id, q WHERE vec_id <> 0)
    SELECT vec_id FROM s ORDER BY 0.5::double * near + 0.5::double * words DESC, vec_id LIMIT 10"""
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten objects with the best mean of likeness to a vector and share of words found: a top-k search for one query."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = rows.where(F.col("doc_id") == 0).select(F.col("embedding").alias("e"))
    met = rows.where(F.col("doc_id") != 0).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").crossJoin(F.broadcast(asked))  # one row
    found = sum(F.contains("text", F.lit(w)).cast("int") for w in ("the", "and", "of")) / F.lit(3.0)
    score = 0.5 * _cosine(F.col("embedding"), F.col("e")) + 0.5 * found
    return met.withColumn("score", score).orderBy(F.desc("score"), "doc_id").limit(10).select(F.col("doc_id").alias("vec_id"))


@query(
    f"""WITH {_TWO_TURNS} SELECT conv_id, CASE WHEN q2 <> '' THEN '[MOCK DEMO] Turn 2 response to: ' || q2 ELSE 'Error: No message provided' END AS response,
    CASE WHEN q2 <> '' THEN '5' ELSE '0' END AS message_count, true AS same_context FROM b WHERE q1 <> ''"""
)
def smart_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns by the chat node whose context keeps its id: the second is given the first one's id alone."""
    graph = _chat_graph("smart_chat", "context_id")
    first = written(_turn(_asked_twice(spark, sf_dir).where("first <> ''").withColumn("_context", F.lit(None).cast("string")), None, "first", graph))
    contexts = first.select("context_write.*").dropDuplicates(["context_key"])
    done = _turn(first.select("conv_id", "last", F.col("context_key").alias("_context")), contexts, "last", graph)
    return done.select("conv_id", "response", "message_count", (F.col("context_key") == F.col("_context")).alias("same_context"))


def _kept(spark: SparkSession, sf_dir: str, overwrite: bool, *ports: str) -> tuple[DataFrame, DataFrame]:
    """A store that holds half of the customers, and what a graph tells that is to store each of them for a day."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    never, then = F.lit(None).cast("timestamp_ntz"), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    store = rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("context_key"), F.lit("old").alias("context_data"), then.alias("created_at"), then.alias("updated_at"), never.alias("expires_at"))
    nodes = {"k": ("input", {"label": "c_custkey"}), "d": ("input", {"label": "c_name"}), "put": ("context_store", {"overwrite": overwrite})} | {p: ("output", {}) for p in ports}
    graph = Graph.of("keep", nodes, [("k.output", "put.context_key"), ("d.output", "put.context_data"), *[(f"put.{p}", f"{p}.input") for p in ports]])
    return store, Engine(store=store, now=NOW).run(graph, rows, keep=["c_custkey"])


@query("SELECT c_custkey, c_custkey::varchar AS stored_key, CASE WHEN c_custkey % 2 = 1 THEN 'true' ELSE 'false' END AS success FROM customer")
def context_store_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph tells that may not overwrite."""
    _, done = _kept(spark, sf_dir, False, "stored_key", "success")
    return done.select("c_custkey", F.col("stored_key.result").alias("stored_key"), F.col("success.result").alias("success"))


@query(
    f"""SELECT c_custkey::varchar AS context_key, c_name AS context_data, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-31 12:00:00' ELSE TIMESTAMP '{NOW}' END AS created_at,
    TIMESTAMP '{NOW}' + INTERVAL 24 HOUR AS expires_at FROM customer"""
)
def context_store_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a graph has stored every customer."""
    store, done = _kept(spark, sf_dir, True, "write")
    return context.stored(store, done.select("write.result.*")).select("context_key", "context_data", "created_at", "expires_at")


@query(
    f"""WITH s AS (SELECT 'ctx_' || event_type || '_' || event_id AS k, CASE WHEN event_id % 5 > 0 THEN ts + to_hours(((event_id % 5) * 60)::bigint) END AS expires FROM events),
    n AS (SELECT least(count(*), 20)::varchar AS n FROM s WHERE contains(k, 'click') AND (expires IS NULL OR expires > TIMESTAMP '{NOW}'))
    SELECT c_custkey, n AS listed FROM customer, n"""
)
def context_list_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that lists contexts, run for every customer: the listing is a page of 20."""
    graph = Graph.of("list", {"all": ("context_list", {"filter": "click", "limit": 20}), "n": ("output", {})}, [("all.count", "n.input")])
    done = Engine(store=_event_store(spark, sf_dir), now=NOW).run(graph, table(spark, sf_dir, "customer").select("c_custkey"))
    return done.select("c_custkey", F.col("n.result").alias("listed"))


@query("SELECT event_id, upper(event_type) AS result FROM events")
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, and read again as the requests of executions."""
    path = new_folder(spark)
    write_events(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text")), path)
    rows = requests(spark, path, "event_id long, text string")
    return Engine().run(_transform("uppercase"), rows, keep=["event_id"]).select("event_id", F.col("out.result").alias("result"))


@query(
    """SELECT 'fails' AS graph, CASE WHEN coalesce(lang <> 'de', false) THEN 'completed' ELSE 'failed' END AS status, CASE WHEN coalesce(lang <> 'de', false) THEN upper(replace(text, 'ß', 'ss')) END AS result,
    CASE WHEN coalesce(lang <> 'de', false) THEN NULL ELSE 'Graph execution failed: Node up failed: Invalid inputs for node up. Missing required inputs: [''text'']' END AS error FROM documents"""
)
def recorded_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An execution for each document, recorded in a catalog, and read back by graph."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    kept = catalog.Catalog(spark, new_folder(spark))
    graph = _failing_graph()
    kept.record(Engine().execute(graph, rows))
    done = kept.executions(graph.name)
    return done.select("graph", "status", F.get_json_object("outputs", "$.out.result").alias("result"), F.map_values("errors")[0].alias("error"))


@query("SELECT c_custkey, upper(c_name) AS result, 2::bigint AS n_runs, 2::bigint AS run_count FROM customer")
def instance_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance that is run twice on every customer: what it recorded, and how many runs its state tells."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text"))
    graph = _transform("uppercase")
    kept = instances.Instances(spark, new_folder(spark), Engine(graphs={graph.name: graph}))
    made = kept.create(graph.name)
    for _ in range(2):
        kept.execute(made, rows)
    body = F.from_json("body", "c_custkey long, out struct<result:string>")
    told = kept.runs(made).select("run_id", body.alias("b")).groupBy("b.c_custkey", "b.out.result").agg(F.count_distinct("run_id").alias("n_runs"))
    return told.withColumn("run_count", F.lit(kept.get(made)["run_count"]).cast("long"))


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: the windows of the streaming count, over a whole table."""
    counts = instances.windowed(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "1 hour", "1 hour", ["event_type"])
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
