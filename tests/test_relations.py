"""Running values by ranges, against plain Python, and questions about tables of graphs."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import ordered
from loomspan.plans import relations
from loomspan.plans.graph import Graph


@pytest.fixture(scope="module")
def rows():
    """One key holds most rows, so its rows span all pieces; there are null keys, null values, and clashing names."""
    made, at = [], random.Random(3)
    for k in range(600):
        made.append((k, at.choice(["hot", "hot", "hot", "hot", None, "a", "b", f"s{k % 50}"]), at.randrange(40), at.choice([None, "x", "y", f"v{k}"])))
    return made


def by_key(rows):
    seen = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        seen.setdefault(r[1], []).append(r)
    return seen


def test_running_sum(spark, rows):
    table = spark.createDataFrame(rows, "id long, _Opiece string, at long, v string")
    got = {r.id: r.n for r in ordered.running_sum(table, ["_Opiece"], ["at", "id"], "n").collect()}
    assert got == {r[0]: n for rs in by_key(rows).values() for n, r in enumerate(rs, 1)}
    what = F.when(F.col("v") == "x", 2)  # null elsewhere
    got = {r.id: r.v for r in ordered.running_sum(table, ["_Opiece"], ["at", "id"], "v", what).collect()}
    for rs in by_key(rows).values():
        total = None
        for r in rs:
            total = (total or 0) + 2 if r[3] == "x" else total
            assert got[r[0]] == total


def test_previous(spark, rows):
    table = spark.createDataFrame(rows, "id long, k string, at long, v string")
    got = {r.id: (r.v, r.b) for r in ordered.previous(table, ["k"], ["at", "id"], {"v": "v", "b": "id"}).collect()}
    expected = {}
    for rs in by_key(rows).values():
        for before, r in zip([None, *rs], rs, strict=False):
            expected[r[0]] = (before[3], before[0]) if before else (None, None)
    assert got == expected
    assert ordered.previous(table.limit(0), ["k"], ["at"], {"b": "id"}).count() == 0


def test_relations_of_a_graph(spark):
    nodes = {"a": ("input", {}), "b": ("input", {}), "j": ("text_concat", {}), "u": ("text_transform", {}), "out": ("output", {})}
    edges = [("a.output", "j.text1"), ("b.output", "j.text2"), ("a.output", "u.text"), ("u.output", "j.text3"), ("j.output", "out.input"), ("j.output", "out.input"), ("j.output", "nowhere.x")]
    graph = Graph.of("g", nodes, edges)
    rows, ways = graph.node_rows(spark), graph.edge_rows(spark)
    assert [r.target for r in relations.dangling(ways, rows).collect()] == ["nowhere"] and relations.dangling(ways, rows, "source").count() == 0
    assert {r.target: r.in_degree for r in relations.in_degrees(ways).collect()} == {"j": 3, "u": 1, "out": 2, "nowhere": 1}
    assert [(r.source, r.target, r.n) for r in relations.repeated(ways).collect()] == [("j", "out", 2)]
    assert {r.node_id: r.ordinal_key for r in relations.input_keys(rows).collect()} == {"a": "input_1", "b": "input_2"}
    assert {r.node: r.depth for r in relations.depths(rows, ways).collect()} == {"a": 0, "b": 0, "u": 1, "j": 2, "out": 3}
    assert {r.node: r.depth for r in relations.depths(rows, ways, rows.where("node_id = 'u'")).collect()} == {"u": 0, "j": 1, "out": 2}
    kinds = relations.by_category(rows.select(F.col("node_type").alias("category"), F.col("node_id").alias("member")))
    assert {(r.category, r.member): r.n for r in kinds.collect()} == {("input", "a"): 2, ("input", "b"): 2, ("text_concat", "j"): 1, ("text_transform", "u"): 1, ("output", "out"): 1}
    loop = spark.createDataFrame([("g", "a", "j"), ("g", "j", "u"), ("g", "u", "j")], "graph string, source string, target string")
    with pytest.raises(ValueError, match="cycles"):
        relations.depths(rows, loop)
