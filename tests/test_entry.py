"""Every query of the engine against its SQL, on the small tables."""

import hashlib
import json
import os
from collections import Counter

import duckdb
import pytest

from loomspan import queries
from tests.conftest import DATA

NAMES = list(queries.queries())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def canonical(rows):
    return Counter(tuple(None if v != v else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    if name not in queries.oracle_sql():
        assert len(got)
        return
    expected = sql.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert canonical(got[columns].itertuples(index=False)) == canonical(expected[columns].itertuples(index=False))


def test_title_by_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.result == docs[r.doc_id].title() for r in queries.transform_title(spark, DATA).collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_levels_have_no_row_limit(spark):
    """The rows of a recursive statement are limited by a setting; levels aren't."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = {r.node: r.depth for r in queries.graph_levels(spark, DATA).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    nodes = {r.p_partkey for r in spark.read.parquet(f"{DATA}/part.parquet").collect()} - {0}
    depth = {n: (n & -n).bit_length() - 1 for n in nodes}
    assert got == {n: d for n, d in depth.items() if all(n >> k in nodes for k in range(d + 1))} and len(got) > 50


def test_escaped_keys_by_json_dumps(spark, tmp_path):
    """Keys of every conversation, with text that isn't ASCII, control characters, an empty and a missing last message."""
    lasts = ["plain", "héllo – 漢字 😀", 'tab\t "q" \\u001F \x01\x7f\n', "", None]
    rows = [(k, 0, "user", "Été") for k in range(5)] + [(k, 1, "assistant", t) for k, t in enumerate(lasts)]
    rows += [(9, t, r, x) for _, t, r, x in rows[:1] + rows[5:6]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()

    def key(*messages):
        plain = json.dumps([{"role": r or "", "content": t or ""} for r, t in messages], sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(plain.encode()).hexdigest()[:16]

    talks = {k: [(r, t) for i, _, r, t in rows if i == k] for k in (0, 1, 2, 3, 4, 9)}
    assert {(r.conv_id, r.turn): r.context_key for r in got("context_prefix_key_escaped")} == {(k, n): key(*m[: n + 1]) for k, m in talks.items() for n in (0, 1)}
    groups = Counter(key(*m) for m in talks.values())
    assert {r.context_key: r.n_conversations for r in got("context_dedupe_escaped")} == groups and max(groups.values()) == 2
    reply = "[MOCK DEMO] Turn 2 response to: go on"
    assert {r.conv_id: r.context_key for r in got("chat_continue_escaped")} == {k: key(*m, ("user", "go on"), ("assistant", reply)) for k, m in talks.items()}
    start = ("system", "You are a helpful AI assistant.")
    said = {k: m[-1][1] for k, m in talks.items()}
    tokens = {r.conv_id: (r.response, r.context_key) for r in got("context_token_all")}
    for k, t in said.items():
        answer = f"[MOCK MOCK] Turn 1 response to: {t}"
        assert tokens[k] == ((answer, key(start, ("user", t), ("assistant", answer))) if t else ("Error: No message provided", "empty"))
    assert len(tokens) == 6
