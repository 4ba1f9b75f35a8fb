import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from loomspan.llm import common, url_filter, url_filter_sql
from loomspan.llm.queries import URL_RULES

ROWS = [
    (1, "http://Www.Example.ORG/es/1?x#y"),
    (2, "https://example.org/en/12"),
    (3, "https://org/x"),
    (4, "http://notorg/x"),
    (5, None),
    (6, ""),
    (7, "no scheme/com/de/"),
    (8, "http://a.com/de/x"),
    (9, "http://a.com/fr/x"),
    (10, "http://a.com/es/1.html"),
    (11, "http://a.com"),
    (12, "http://ÄB.com/de/?q"),
    (13, "x://y://example.org/en/1"),
    (1, "http://www.example.org/es/1?x#y"),
    (14, "http://example.org#frag/es/"),
]


def frame(spark, rows=None):
    return spark.createDataFrame([(*r, "h", 1, "v", 2) for r in (ROWS if rows is None else rows)], "page_id long, url string, host string, row int, verdict string, node int")


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in url_filter.judged(frame(spark), URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2].rule == "example.org/en/1" and got[2].verdict == "block"
    assert got[3].rule == "org/" and got[4].rule is None
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (5, 6, 7))
    assert got[8].rule == "com/de/" and got[9].rule == "com/fr/" and got[10].rule is None
    assert (got[11].path, got[11].rule) == ("", None)
    assert got[12].host == "Äb.com"  # only A-Z is lower-cased
    assert (got[13].host, got[13].path) == ("y:", "//example.org/en/1")
    assert (got[14].host, got[14].path, got[14].rule) == ("example.org", "", None)
    assert {"row", "node"} <= set(got[1].asDict()) and all(r.verdict in ("allow", "block") for r in got.values())


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://s.net/spam/{i}.html", 1) for i in range(60)] + [(100 + i, f"http://s.net/news/{i}", 0) for i in range(60)]
    rows += [(200 + i, f"http://s.net/spam/x{i}.html", None) for i in range(5)] + [(300 + i, f"http://s.net/news/y{i}9", None) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_filter.judged(df, {}, labels="bad").collect()}
    assert {got[200 + i].verdict for i in range(5)} == {"block"} and {got[300 + i].verdict for i in range(5)} == {"allow"}
    assert got[0].template.startswith("/spam/") and got[100].template.startswith("/news/")


def test_like_branches_merge(spark):
    rows = [(i, f"http://s.net/{'ab'[i % 2]}/{i}", i // 2 % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    assert {r.template for r in url_filter.judged(df, {}, labels="bad").collect()} == {"/+/+"}


def test_empty_table(spark):
    assert url_filter.judged(frame(spark, []), URL_RULES).count() == 0


def seen(segment):
    ending = re.search(r"\.[A-Za-z]+$", segment)
    return "*" + (ending[0] if ending else "") if re.search("[0-9]", segment) else segment


def walked(urls):
    """(template, share) of each (host, segments, label), by plain recursion over the urls of a node."""
    told = [label for _, _, label in urls if label is not None]
    whole = (sum(told) + 1) / (len(told) + 2)
    out = [None] * len(urls)

    def count(rows):
        labels = [urls[i][2] for i in rows if urls[i][2] is not None]
        return len(labels), sum(labels)

    def below(rows, level, node, share):
        groups = defaultdict(list)
        for i in rows:
            if level == len(urls[i][1]):
                out[i] = (node, share)
            else:
                groups[seen(urls[i][1][level])].append(i)
        shapes = defaultdict(list)
        for name, part in groups.items():
            shapes["*" if len(part) < 5 and not name.startswith("*") else name] += part
        n, bad = count([i for part in groups.values() for i in part])
        rate, branches = (bad + 1) / (n + 2), defaultdict(list)
        for name, part in shapes.items():
            labelled, b = count(part)
            away = labelled and abs(b - labelled * rate) >= 2 * math.sqrt(labelled * rate * (1 - rate))
            branches[name if away else "+"] += part
        for name, part in branches.items():
            labelled, b = count(part)
            below(part, level + 1, f"{node}/{name}", (b + 4 * share) / (labelled + 4))

    hosts = defaultdict(list)
    for i, (host, _, _) in enumerate(urls):
        hosts[host].append(i)
    for rows in hosts.values():
        n, bad = count(rows)
        below(rows, 0, "", (bad + 4 * whole) / (n + 4))
    return out


def deep_rows():
    rng = random.Random(3)
    names = ["news", "shop", "tag", "a", "b", "p1", "p22", "x.html", "7.html", "rare"]
    rows = []
    for k in range(500):
        path = [rng.choice(names[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 7))]
        label = rng.choice([0, 1, None]) if "shop" not in path[:5] else 1 if rng.random() < 0.9 else None
        rows.append((k, f"http://h{rng.choice([0, 0, 0, 1, 2])}.net/{'/'.join(path)}", label))
    rows += [(600 + k, "http://long.net/" + "/".join(["deep"] * 300 + [str(k // 5)]), k % 2) for k in range(10)]
    return rows + [(700 + k, f"http://six.net/a/b/c/{'bad' if k % 2 else 'good'}/e{k}/f", k % 2) for k in range(200)]


@pytest.mark.parametrize("share", [1000, 0, 20])
def test_the_tree_by_plain_recursion(spark, monkeypatch, share):
    """Paths of up to 301 segments; every node hot, none, some."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = deep_rows() if share == 20 else [r for r in deep_rows() if "long" not in r[1]]
    expected = walked([(u.split("/")[2], [x for x in u.split("/")[3:] if x], label) for _, u, label in rows])
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_filter.judged(df, {}, labels="bad").collect()}
    assert {k: got[k].template for k in got} == {r[0]: t for r, (t, _) in zip(rows, expected)}
    assert all(abs(got[r[0]].bad_share - x) < 1e-9 for r, (_, x) in zip(rows, expected))
    assert {got[k].verdict for k in range(701, 900, 2)} == {"block"} and {got[k].verdict for k in range(700, 900, 2)} == {"allow"}


def test_sql_follows_paths_to_their_end(spark):
    """The SQL's recursion gives the same rows on deep paths, judged by rules."""
    rows = [(k, u.replace("h0.net/shop", "h0.com/de/shop").replace("six.net/a", "six.com/fr")) for k, u, _ in deep_rows() if "long" not in u] + [(k, u) for k, u in ROWS if k < 15]
    rows = [(i, u) for i, (_, u) in enumerate(rows)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(url_filter_sql.sql(URL_RULES)).fetchall())
    assert max(r.template.count("/") for r in got) > 5


def test_clashing_columns_in_any_case(spark):
    names = "HOST string, Row_Host string, _m int, _M_fit string, Template int, seen int, N string"
    df = spark.createDataFrame([(k, u, "x", "x", 1, "x", 1, 1, "x") for k, u in ROWS], f"page_id long, url string, {names}")
    out = url_filter.judged(df, URL_RULES)
    assert out.count() == len(ROWS) and {"Row_Host", "_m", "_M_fit", "seen", "N"} <= set(out.columns)
    assert [c for c in out.columns if c.lower() == "host"] == ["host"]
