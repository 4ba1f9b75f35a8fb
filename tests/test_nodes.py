import hashlib
import http.server
import itertools
import json
import re
import threading

import pytest
from pyspark.sql import functions as F

from loomspan.functions import conversation as talk
from loomspan.functions import text as texts
from loomspan.operators import BUILT_IN, Built, Registry, Value, context
from loomspan.operators.base import NodeClass
from loomspan.operators.chat import answered, capabilities, hosted_provider, local_provider
from loomspan.operators.text import java_pattern
from loomspan.plans.compiler import Engine
from loomspan.plans.graph import Graph


def ports(spark, node, params, given, wanted, **engine):
    """Runs one node on rows of its input ports; its wanted ports by row."""
    names = list(given[0])
    nodes = {f"i_{n}": ("input", {"label": n, "value": None}) for n in names} | {"x": (node, params)}
    nodes |= {f"o_{p}": ("output", {}) for p in wanted}
    edges = [(f"i_{n}.output", f"x.{n}") for n in names] + [(f"x.{p}", f"o_{p}.input") for p in wanted]
    rows = spark.createDataFrame([(k, *[g[n] for n in names]) for k, g in enumerate(given)], "k long, " + ", ".join(f"{n} string" for n in names))
    done = Engine(**engine).run(Graph.of("g", nodes, edges), rows).orderBy("k").collect()
    return [tuple(r[f"o_{p}"]["result"] if r[f"o_{p}"] else None for p in wanted) for r in done]


SAMPLES = ["it's o'neil-smith x2y", "\t\xa0pad　\r\n", "a😀b é", "ÉTÉ ǆ ß", "", "UPPER lower Title", "１２ a", "don't  stop"]


@pytest.mark.parametrize(("operation", "python"), [("uppercase", str.upper), ("lowercase", str.lower), ("title", str.title), ("strip", str.strip), ("reverse", lambda t: t[::-1]), ("unknown", lambda t: t)])
def test_text_transform(spark, operation, python):
    got = ports(spark, "text_transform", {"operation": operation}, [{"text": t} for t in SAMPLES], ["output"])
    assert [g for (g,) in got] == [python(t) for t in SAMPLES]


def test_words_and_spaces(spark):
    rows = spark.createDataFrame([(t,) for t in [*SAMPLES, texts.SPACES, f"a{texts.SPACES}b"]], "t string")
    assert [r[0] for r in rows.select(texts.words(F.col("t"))).collect()] == [t.split() for t in [*SAMPLES, texts.SPACES, f"a{texts.SPACES}b"]]
    assert [r[0] for r in rows.select(texts.word_count(F.col("t"))).collect()] == [len(t.split()) for t in [*SAMPLES, texts.SPACES, f"a{texts.SPACES}b"]]
    assert all(c.isspace() for c in texts.SPACES) and len(texts.SPACES) == 29


@pytest.mark.parametrize("pattern", [r"[A-Z]+", r"\w+", "a*", r"x(\d)", r"(?P<q>l)o", "["])
def test_text_filter(spark, pattern):
    given = ["Hello World x1 x2", "baac", "", "élan [vital] lo"]
    got = ports(spark, "text_filter", {"pattern": pattern}, [{"text": t} for t in given], ["matches", "filtered"])
    if pattern == "[":
        assert got == [("[" if "[" in t else "", t.replace("[", "")) for t in given]
    else:
        assert got == [("\n".join(re.findall(pattern, t)), re.sub(pattern, "", t)) for t in given]


def test_text_filter_others(spark):
    given = [{"text": "abab"}]
    assert ports(spark, "text_filter", {"pattern": ""}, given, ["matches", "filtered"]) == [("", "abab")]
    assert ports(spark, "text_filter", {"pattern": "(a)(b)"}, given, ["matches"]) == [(None,)]
    assert ports(spark, "text_filter", {"pattern": r"(?P<c>a)b(?P=c)"}, given, ["matches", "filtered"]) == [("a", "b")]


def test_text_concat(spark):
    assert ports(spark, "text_concat", {"separator": "-"}, [{"text1": "a", "text2": "", "text3": "c"}, {"text1": "0", "text2": None, "text3": None}], ["output"]) == [("a-c",), ("0",)]


@pytest.mark.parametrize(("text", "number"), [("3.0", 3.0), ("7", 7.0), ("1e3", 0.0), ("1_000", 1000.0), (" 5 ", 5.0), ("NaN", 0.0), ("", 0.0), ("1.5.2", 0.0), ("-.5", -0.5), ("2.", 2.0), ("1.5e2", 150.0), (".", 0.0)])
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(texts.number(F.col("t"))).first()[0] == number


DATA = {"a": {"b": 1, "n": None, "t": True, "o": {"x": [1, "y"]}, "f": 1.5}, "s": "text"}


@pytest.mark.parametrize("path", ["a.b", "a.n", "a.t", "a.o", "a.f", "s", "a.zip", "s.deep", "zip.b", "a.o.x.0", ""])
def test_json_extract(spark, path):
    at, reason = DATA, "missing_data_or_key" if not path else None
    for part in path.split(".") if path else []:
        if not isinstance(at, dict) or part not in at:
            reason = f"key_not_found: {part}"
            break
        at = at[part]
    expected = ("dflt" if reason else str(at), not reason, reason)
    data = json.dumps(DATA)
    graph = Graph.of("g", {"d": ("input", {"label": "d", "data_type": "json"}), "k": ("input", {"label": "k"}), "x": ("json_extract", {"key_path": path, "default_value": "dflt"}), "y": ("json_extract", {"key_path": "s", "default_value": "dflt"}), "v": ("output", {}), "f": ("output", {}), "w": ("output", {})}, [("d.output", "x.data"), ("d.output", "y.data"), ("k.output", "y.key"), ("x.value", "v.input"), ("x.found", "f.input"), ("y.value", "w.input")])
    row = Engine().run(graph, spark.createDataFrame([(data, path)], "d string, k string")).first()
    found = (row["v"]["result"], row["f"]["result"]["success"], row["f"]["result"]["reason"])
    assert found == expected
    assert row["w"]["result"] == ("text" if not path else expected[0])  # a key port that isn't empty wins


def test_json_extract_of_empty_data(spark):
    got = ports(spark, "json_extract", {"key_path": "a", "default_value": "d"}, [{"data": "{}"}, {"data": "not json"}], ["value"])
    assert got == [("d",), ("d",)]


def test_json_reads_as_python_does(spark):
    """Fractions, orders of keys, repeated keys and long numbers, by the text that was parsed."""
    values = ["1.0", "0.000001", "1e22", "1E400", "-0.0", "12345678901234567890123", "1.50", '{"z": 1, "a": [1.0, null, true]}', '"1.0"', "null", "[]", '{"k": 1, "k": {"b": 2.0}}', "NaN", '"\\u00e9 \\"q\\""', "7"]
    texts_ = [f'{{"x": {{"v": {v}}}, "n": 0}}' for v in values] + ['{"x": 1, "x": {"v": 2}}', '{"x": {"v": 1}, "x": 3}', "[1", "", None, "{}", "null", '{"x": {"v": 1', '"text"']

    def plain(text):
        if text is None:
            return "d"
        try:
            at = json.loads(text)
        except ValueError:
            at = text
        for part in ("x", "v"):
            if not isinstance(at, dict) or part not in at:
                return "d"
            at = at[part]
        return str(at)

    rows = spark.createDataFrame(list(enumerate(texts_)), "id long, t string")
    for more in ({}, {"stringify": False}):
        for kind in ("json", "text"):
            graph = Graph.of("g", {"d": ("input", {"label": "t", "data_type": kind}), "x": ("json_extract", {"key_path": "x.v", "default_value": "d", **more}), "c": ("text_concat", {"separator": ""}), "v": ("output", {}), "w": ("output", {})}, [("d.output", "x.data"), ("x.value", "c.text1"), ("x.value", "v.input"), ("c.output", "w.input")])
            got = {r.id: r for r in Engine().run(graph, rows, keep=["id"]).select("id", F.col("v.result").alias("v"), F.col("w.result").alias("w")).collect()}
            for k, text in enumerate(texts_):
                if not more:
                    assert got[k].v == plain(text), text
                falsy = plain(text) in ("None", "[]", "-0.0", "0.0")
                if not (more and falsy):
                    assert got[k].w == plain(text), text


def test_model_and_provider_by_row(spark):
    asked = [("hi", "mock", "a"), ("yo", "loud", None), ("hm", "none", "b"), ("ok", None, ""), (None, "loud", "c")]
    graph = Graph.of("g", {"m": ("input", {"label": "m"}), "p": ("input", {"label": "p"}), "w": ("input", {"label": "w"}), "c": ("immutable_chat", {"model": "own"}), "r": ("output", {})}, [("m.output", "c.message"), ("p.output", "c.provider"), ("w.output", "c.model"), ("c.response", "r.input")])
    rows = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "id long, m string, p string, w string")
    done = Engine(providers={"loud": lambda text: text.upper()[-20:]}).run(graph, rows, keep=["id"])
    got = {r.id: r.r.result for r in done.collect()}
    assert got == {0: "[MOCK A] Turn 1 response to: hi", 1: "HUMAN: YO\n\nASSISTANT:"[-20:], 2: "Error: provider none is not set up", 3: "[MOCK OWN] Turn 1 response to: ok", 4: "Error: No message provided"}


def test_contexts_with_metadata(spark):
    """Stored under the key that is told, with metadata, for a day by default; and found again with it."""
    now = "2024-01-01 20:00:00"
    asked = [{"context_key": "k", "context_data": "v", "metadata": '{"b": 1.0, "a": 2}'}, {"context_key": "", "context_data": "w", "metadata": "{}"}]
    rows = ports(spark, "context_store", {}, asked, ["stored_key", "write"], now=now)
    assert rows[0][0] == "k" and rows[1][0].startswith("ctx_") and str(rows[0][1].expires_at) == "2024-01-02 20:00:00"
    writes = spark.createDataFrame([r[1] for r in rows], "context_key string, context_data string, written_at timestamp_ntz, expires_at timestamp_ntz, metadata string")
    store = context.stored(spark.createDataFrame([], context.STORE), writes)
    got = ports(spark, "context_retrieve", {}, [{"context_key": "k"}, {"context_key": "none"}], ["context_data", "found"], store=store, now=now)
    assert got == [("v", "true"), ("{}", "false")]
    graph = Graph.of("g", {"k": ("input", {"label": "k"}), "get": ("context_retrieve", {}), "x": ("json_extract", {"key_path": "b"}), "all": ("context_list", {"pattern": "k"}), "v": ("output", {}), "l": ("output", {})}, [("k.output", "get.context_key"), ("get.metadata", "x.data"), ("x.value", "v.input"), ("all.contexts", "l.input")])
    row = Engine(store=store, now=now).run(graph, spark.createDataFrame([("k",)], "k string")).first()
    assert row.v.result == "1.0"
    assert json.loads(row.l.result) == [{"context_key": "k", "age_hours": 0.0, "created_at": "2024-01-01T20:00:00", "updated_at": "2024-01-01T20:00:00", "expires_at": "2024-01-02T20:00:00", "is_expired": False, "metadata": {"a": 2, "b": 1}, "data_size": 1}]


def test_json_extract_tells_what_it_found(spark):
    rows = spark.createDataFrame([(0, '{"k": [1, "x"]}'), (1, "{}")], "id long, t string")
    graph = Graph.of("g", {"d": ("input", {"label": "t", "data_type": "json"}), "x": ("json_extract", {"key_path": "k"}), "f": ("output", {})}, [("d.output", "x.data"), ("x.found", "f.input")])
    got = {r.id: json.loads(r.f) for r in Engine().run(graph, rows, keep=["id"]).select("id", F.to_json("f.result").alias("f")).collect()}
    assert got == {0: {"success": True, "extracted": [1, "x"]}, 1: {"success": False, "reason": "missing_data_or_key"}}


def test_json_replace_of_what_is_no_json(spark):
    given = [{"data": "not json", "value": "v"}, {"data": '{"k": 1, "k": 2.0}', "value": "v"}]
    got = ports(spark, "json_replace", {"key_path": "a"}, given, ["text", "success"])
    assert [(t, s.reason) for t, s in got] == [('"not json"', "target_not_dict"), ('{"k":2.0,"a":"v"}', None)]


def test_json_replace(spark):
    def run(data, path, **more):
        graph = Graph.of("g", {"d": ("input", {"label": "d", "data_type": "json"}), "v": ("input", {"label": "v"}), "r": ("json_replace", {"key_path": path, **more}), "t": ("output", {}), "s": ("output", {})}, [("d.output", "r.data"), ("v.output", "r.value"), ("r.text", "t.input"), ("r.success", "s.input")])
        row = Engine().run(graph, spark.createDataFrame([(json.dumps(data), 'q"uote')], "d string, v string")).first()
        return json.loads(row["t"]["result"]), row["s"]["result"]["success"], row["s"]["result"]["reason"]

    assert run({"a": 1}, "b.c") == ({"a": 1, "b": {"c": 'q"uote'}}, True, None)
    assert run({"a": 1}, "b.c", create_if_missing=False) == ({"a": 1}, False, "path_not_found: b")
    assert run({"a": 1}, "a.b.c") == ({"a": 1}, False, "invalid_path_type: b")
    assert run({"a": 1}, "a.b") == ({"a": 1}, False, "target_not_dict")


def test_context_keys(spark):
    talks = [[("user", "héllo 😀\x7f \x01 \\u001F \"q\"\n")], [("system", "a"), ("user", "b")], [(None, None)], []]
    rows = spark.createDataFrame([(k, [{"role": r, "content": c} for r, c in m]) for k, m in enumerate(talks)], "k int, m array<struct<role:string,content:string>>")
    for ascii_only in (True, False):
        plain = [json.dumps([{"content": c or "", "role": r or ""} for r, c in m], sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only) for m in talks]
        got = [r[0] for r in rows.orderBy("k").select(talk.canonical(F.col("m"), ascii_only)).collect()]
        assert got == plain if ascii_only else got[1:] == plain[1:]
        keys = [r[0] for r in rows.orderBy("k").select(talk.context_key(F.col("m"), ascii_only)).collect()]
        assert keys[1:] == [hashlib.sha256(p.encode()).hexdigest()[:16] for p in plain[1:]]


def test_rewind_and_prompt(spark):
    m = [{"role": r, "content": c} for r, c in (("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "t"))]
    rows = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    assert rows.select(talk.prompt(F.col("m"), F.lit("q"))).first()[0] == "System: s\n\nHuman: u\n\nAssistant: a\n\nHuman: q\n\nAssistant:"
    sizes = [rows.select(F.size(talk.rewind(F.col("m"), F.lit(k)))).first()[0] for k in (0, 1, 2, 3)]
    assert sizes == [4, 2, 4, 4]


def test_chat_nodes(spark):
    got = ports(spark, "immutable_chat", {"model": "demo"}, [{"message": "hi"}, {"message": ""}, {"message": None}], ["response", "message_count", "context_key"])
    history = [("system", "You are a helpful AI assistant."), ("user", "hi"), ("assistant", "[MOCK DEMO] Turn 1 response to: hi")]
    key = hashlib.sha256(json.dumps([{"content": c, "role": r} for r, c in history], separators=(",", ":")).encode()).hexdigest()[:16]
    assert got == [("[MOCK DEMO] Turn 1 response to: hi", "3", key)] + [("Error: No message provided", "0", "empty")] * 2
    (first, again) = ports(spark, "smart_chat", {}, [{"message": "hi", "context_id": "c1"}, {"message": "hi", "context_id": None}], ["response", "context_id"])
    assert first == ("[MOCK MOCK] Turn 1 response to: hi", "c1") and again[1].startswith("ctx_")
    asked = ports(spark, "immutable_chat", {"provider": "mine"}, [{"message": "hi"}], ["response"], providers={"mine": lambda p: p[-30:]})
    assert asked == [("System: You are a helpful AI assistant.\n\nHuman: hi\n\nAssistant:"[-30:],)]
    assert ports(spark, "immutable_chat", {"provider": "none"}, [{"message": "hi"}], ["response"]) == [("Error: provider none is not set up",)]
    assert spark.createDataFrame([("a",), (None,)], "p string").select(answered(F.col("p"), str.upper)).collect()[1][0] is None
    assert capabilities(spark).where("context_caching").count() == 2


def test_context_store(spark):
    now = "2024-01-02 00:00:00"
    store = spark.sql("SELECT 'k' AS context_key, 'old' AS context_data, timestamp_ntz'2024-01-01 13:30:00' AS created_at, timestamp_ntz'2024-01-01 13:30:00' AS updated_at, CAST(NULL AS timestamp_ntz) AS expires_at UNION ALL SELECT 'late', 'x', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 01:00:00'")
    ask = [{"context_key": "k"}, {"context_key": "late"}, {"context_key": "none"}]
    get = lambda **p: ports(spark, "context_retrieve", {"default_value": "d", **p}, ask, ["context_data", "found", "age_hours"], store=store, now=now)
    assert get() == [("old", "true", "10.5"), ("d", "false", "0"), ("d", "false", "0")]
    assert get(cleanup_expired=False)[1] == ("d", "false", "expired")
    put = lambda **p: ports(spark, "context_store", p, [{"context_key": "k", "context_data": "new"}, {"context_key": "z", "context_data": "v"}, {"context_key": "e", "context_data": ""}], ["success"], store=store, now=now)
    assert [s for (s,) in put()] == ["true", "true", "false"]
    assert [s for (s,) in put(overwrite=False)] == ["false", "true", "false"]
    written = ports(spark, "context_store", {"expires_hours": 2}, [{"context_key": "z", "context_data": "v"}], ["write"], store=store, now=now)[0][0]
    assert str(written["expires_at"]) == "2024-01-02 02:00:00"
    writes = spark.createDataFrame([("k", "new"), ("z", "v")], "context_key string, context_data string").selectExpr("*", f"timestamp_ntz'{now}' AS written_at", "CAST(NULL AS timestamp_ntz) AS expires_at")
    after = {r.context_key: r for r in context.stored(store, writes).collect()}
    assert after["k"].context_data == "new" and str(after["k"].created_at) == "2024-01-01 13:30:00" and len(after) == 3
    assert {r.context_key: r.context_data for r in context.stored(store, writes, overwrite=False).collect()}["k"] == "old"
    assert [r.context_key for r in context.listed(store, F.lit(now).cast("timestamp_ntz")).collect()] == ["k"]
    (count, listing) = ports(spark, "context_list", {"include_expired": True}, [{"trigger": "x"}], ["count", "contexts"], store=store, now=now, lenient=True)[0]
    assert count == "2" and json.loads(listing)[0]["context_key"] == "k"


def test_keys(spark):
    make = lambda seed, **p: ports(spark, "generate_random_key", {"prefix": "p_", "key_length": 10, **p}, [{"seed_data": seed}], ["random_key", "short_key", "hash_key"])[0]
    random, short, hashed = make("seed")
    assert hashed == "p_" + hashlib.sha256(b"seed").hexdigest()[:10] and len(random) == 12 and len(short) == 10
    for form in ("hex", "alphanumeric", "words", "uuid"):
        random, _, hashed = make(None, format=form)
        assert random == hashed and random.startswith("p_") and len(random) <= 12


def test_chats_continue_a_context(spark):
    """By key: the history is loaded, the turn counts on, the new key is of the whole; other rows begin anew."""
    engine = Engine()
    graph = Graph.of("g", {"m": ("input", {"label": "message"}), "k": ("input", {"label": "key"}), "chat": ("immutable_chat", {}), "smart": ("smart_chat", {}), "a": ("output", {}), "b": ("output", {}), "w": ("output", {})}, [("m.output", "chat.message"), ("k.output", "chat.context_key"), ("m.output", "smart.message"), ("k.output", "smart.context_id"), ("chat.response", "a.input"), ("smart.response", "b.input"), ("chat.write", "w.input")])
    first = engine.run(graph, spark.createDataFrame([("hé",)], "message string")).first()
    write = first["w"]["result"]
    contexts = spark.createDataFrame([(write["context_key"], write["messages"])] * 2, "context_key string, messages array<struct<role:string,content:string>>")
    engine = Engine(contexts=contexts)
    rows = spark.createDataFrame([("go", write["context_key"]), ("go", "unknown"), ("go", None)], "message string, key string")
    got = engine.run(graph, rows).select("message", "key", "a.result", F.col("b.result").alias("smart"), F.col("w.result").alias("w")).collect()
    assert len(got) == 3
    said = {(r.message, r.key): r for r in got}
    again = said["go", write["context_key"]]
    assert again.result == again.smart == "[MOCK MOCK] Turn 2 response to: go" and len(again.w["messages"]) == 5
    plain = json.dumps([m.asDict() for m in again.w["messages"]], sort_keys=True, separators=(",", ":"))
    assert again.w["context_key"] == hashlib.sha256(plain.encode()).hexdigest()[:16]
    assert said["go", "unknown"].result == said["go", None].result == "[MOCK MOCK] Turn 1 response to: go"
    assert ports(spark, "immutable_chat", {}, [{"message": None, "context_key": "k"}], ["response", "context_key"], contexts=contexts) == [("Error: No message provided", "k")]


def test_providers(spark):
    """Local and hosted servers: answers, failures, and each distinct request asked once."""
    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            text = body.get("prompt") or body["messages"][-1]["content"]
            reply = b"not json" if "broken" in text else json.dumps({"content": [{"text": body["system"] + "|"}, {"text": text}]} if "messages" in body else {"response": "  fine  "}).encode()
            self.send_response(503 if "fail" in text else 200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        providers = {"local": local_provider(url, "m"), "hosted": hosted_provider(url, "m", "key"), "gone": local_provider("http://127.0.0.1:9", "m")}
        inputs = [{"message": m} for m in ("hello", "hello", "fail", "broken")]
        got = ports(spark, "immutable_chat", {"provider": "local"}, inputs, ["response"], providers=providers)
        assert sorted(r[0] for r in got)[1:] == ["Ollama error: HTTP 503", "fine", "fine"] and sorted(r[0] for r in got)[0].startswith("Error: ")
        assert len(asked) == 3
        got = ports(spark, "immutable_chat", {"provider": "hosted", "system_prompt": "Be kind."}, inputs[1:], ["response"], providers=providers)
        assert sorted(r[0][:30] for r in got) == ["Be kind.|hello", *["Error: Anthropic API error: " + r[0][28:30] for r in sorted(got) if "API" in r[0]]]
        assert asked[-1]["system"] == "Be kind." and {m["role"] for m in asked[-1]["messages"]} == {"user"}
        assert ports(spark, "immutable_chat", {"provider": "gone"}, inputs[:1], ["response"], providers=providers)[0][0].startswith("Error: ")
    finally:
        server.shutdown()


def test_ports_with_defaults_and_classes_as_types(spark):
    class ShoutNode(NodeClass):
        inputs, outputs, defaults = {"text": True}, ("output",), {"text": "nothing"}

        @staticmethod
        def build(call):
            return Built({"output": Value(F.upper(call.get("text").text()))})

    class Named(ShoutNode):
        NODE_TYPE = "loud"

    assert (ShoutNode.as_type().name, Named.as_type().name) == ("shout", "loud")
    registry = Registry(BUILT_IN.values())
    registry.register(ShoutNode.as_type())
    graph = Graph.of("g", {"in": ("input", {"label": "t", "value": None}), "a": ("shout", {}), "b": ("shout", {}), "x": ("output", {}), "y": ("output", {})}, [("in.output", "a.text"), ("a.output", "x.input"), ("b.output", "y.input")])
    rows = spark.createDataFrame([("hi",), (None,)], "t string")
    got = Engine(registry=registry).run(graph, rows).select("status", "x.result", F.col("y.result").alias("y")).collect()
    assert sorted(map(tuple, got)) == [("completed", "HI", "NOTHING"), ("completed", "NOTHING", "NOTHING")]


def test_patterns_mean_what_they_mean_in_python(spark):
    """Matches of many patterns on texts of odd characters, on either path."""
    patterns = [r"a.c", r"b$", r"^b", r"\s+", r"\S+", r"[\s,]+", r"[^\s]+", r"\w+", r"\W+", r"[\w-]+", r"\d+", r"[^\d]+", r"\bx", r"x\b", r"\Bx", r"[a&&b]+", r"[a\]]", r"[]a]+", r"[^]a]+", r"(?i)ß", r"(?i)abc", r"[[]", r"a{2,3}", r"(?:a|b)*c?", r"\.", r"\\", r"(?m)^b$", r"(?s)a.c", r"\Aa", r"a\Z", r"[\W]", r"[\b]", r"(?P<first_one>a)b", r"\u00e9", r"é+"]
    pieces = ["a", "b", "c", "x", "ab", "1", "²", "é", "e\u0301", "ẞ", "ß", "_", "-", "&", "]", "[", ".", "\\", " ", "\t", "\x1c", "\x1f", "\x85", "\u2028", "\r", "\n", "abc", "a\rc", "b\n", "٣"]
    samples = ["".join(p) for p in itertools.product(pieces, repeat=2)] + ["", "b\n\n", "a\nb\nc", "ABC abc", "xax x-x_x"]
    for pattern in patterns:
        got = ports(spark, "text_filter", {"pattern": pattern}, [{"text": t} for t in samples], ["matches", "filtered"])
        assert got == [("\n".join(re.findall(pattern, t)), re.sub(pattern, "", t)) for t in samples], pattern
    assert java_pattern(spark, r"\w+\s") and java_pattern(spark, r"[a&&b]") is None
