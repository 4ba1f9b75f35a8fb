"""URL filters: host and path rules, and for urls that no rule judges a path-template tree for each host.

The tree grows a level at a time. Segments that vary (they hold a digit, or are rare under their parent) become
wildcards; branches whose labels do not differ significantly from their parent's are merged; a template is rejected if
its share of bad labels, smoothed towards its parent's, reaches a threshold."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marker, spread_join, without, written

#: Urls under which a literal segment becomes a wildcard (and a node is not branched any more), z under which a branch is
#: merged, weight of the parent's share, and the share from which a template is rejected.
SUPPORT, SIGNIFICANT, WEIGHT, REJECTED = 5, 2.0, 4.0, 0.6


def host_of(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule ``host/path`` fits its host and all
    subdomains if the path starts with the rule's; the first by name wins among rules of equal length. The rules are
    a dict in the program, so their number is the caller's; they become a map from hosts to rules."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule, verdict in rules.items():
        by_host.setdefault(rule.partition("/")[0], []).append((rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda r, v: F.struct(F.lit(-len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(r[r.index("/") :] if "/" in r else "").alias("path"), F.lit(v).alias("verdict"))
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*[entry(r, v) for r, v in found]))])
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.transform(ends, lambda h: F.coalesce(F.try_element_at(table, h), F.array().cast("array<struct<size:int,rule:string,path:string,verdict:string>>")))), lambda r: F.startswith(path, r["path"]))
    best = F.array_min(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def shape_of(path: Column) -> Column:
    """The segments of a path, in which one that holds a digit is a wildcard with the segment's ending."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s))


def template_tree(shapes: DataFrame, share: float) -> DataFrame:
    """``host``, ``shape``, ``n``, ``template``, ``bad_share`` of each row of ``shapes`` (``host``, ``shape`` array<string>,
    ``n`` urls, ``labelled`` and ``bad`` of them; written). ``share`` is that of all labels.

    The tree grows a level in a round, until no shape has a segment left. Below a node of fewer than SUPPORT urls, or of one
    shape, no branch can differ from its parent significantly: the rest of such paths is done at once, so that rounds are
    as many as levels at which urls part. Nodes go to their children by joins that spread hot nodes.
    """
    total = shapes.count()
    sums = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("rows").alias("rows"))
    smoothed = lambda bad, labelled, above: (bad + WEIGHT * above) / (labelled + WEIGHT)
    hosts = written(shapes.withColumn("rows", F.lit(1).cast("long")).groupBy("host").agg(*sums))
    hosts = hosts.select("host", "rows", F.col("n").alias("urls"), smoothed(F.col("bad"), F.col("labelled"), F.lit(share)).alias("bad_share"))
    now = spread_join(shapes, hosts, {"host": F.col("host")}, {"bad_share": "bad_share", "urls": "urls", "kinds": "rows"}, "rows", total, F.xxhash64("shape"))
    now = written(now.withColumn("node", F.lit("")))
    parts, level = [], 0
    while True:
        more = F.size("shape") > level
        few = (F.col("urls") < SUPPORT) | (F.col("kinds") == 1)
        parts.append(now.where(~more).select("host", "shape", "n", F.col("node").alias("template"), "bad_share"))
        parts.append(_tails(now.where(more & few), level, smoothed))
        now = now.where(more & ~few)
        if now.isEmpty():
            break
        now = now.withColumn("seen", F.get("shape", F.lit(level)))
        seen = written(now.withColumn("rows", F.lit(1).cast("long")).groupBy("host", "node", "bad_share", "seen").agg(*sums))
        rare = (F.col("n") < SUPPORT) & ~F.startswith("seen", F.lit("*"))
        shaped = seen.withColumn("literal", F.when(rare, "*").otherwise(F.col("seen")))
        ones = F.sum(F.lit(1).cast("long")).alias("below")
        alike = written(shaped.groupBy("host", "node", "bad_share", "literal").agg(*sums, ones))
        parents = written(alike.groupBy("host", "node").agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("rate"), ones))
        rated = spread_join(alike, parents, {"host": F.col("host"), "node": F.col("node")}, {"rate": "rate"}, "below", total, F.xxhash64("literal"))
        expected = F.col("labelled") * F.col("rate")
        away = F.abs(F.col("bad") - expected) >= SIGNIFICANT * F.sqrt(expected * (1 - F.col("rate")))
        branched = written(rated.withColumn("branch", F.when((F.col("labelled") > 0) & away, F.col("literal")).otherwise("+")))
        branches = branched.groupBy("host", "node", "bad_share", "branch").agg(F.sum("n").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("rows").alias("kinds"), ones.alias("literals"))
        scored = written(branches.select("host", "node", "branch", "urls", "kinds", "literals", smoothed(F.col("bad"), F.col("labelled"), F.col("bad_share")).alias("next_share")))
        keys = lambda *names: {k: F.col(k) for k in ("host", "node", *names)}
        leads = spread_join(branched, scored, keys("branch"), {"next_share": "next_share", "urls": "urls", "kinds": "kinds"}, "literals", total, F.xxhash64("literal"))
        leads = written(leads.select("host", "node", "literal", "below", F.concat("node", F.lit("/"), "branch").alias("next_node"), "next_share", "urls", "kinds"))
        told = {k: k for k in ("next_node", "next_share", "urls", "kinds")}
        step = spread_join(shaped, leads, keys("literal"), told, "below", total, F.xxhash64("seen"))
        step = written(step.select("host", "node", "seen", "rows", *told))
        now = spread_join(now, step, keys("seen"), told, "rows", total, F.xxhash64("shape"))
        now = written(now.select("host", "shape", "n", "labelled", "bad", F.col("next_node").alias("node"), F.col("next_share").alias("bad_share"), "urls", "kinds"))
        level += 1
    return reduce(DataFrame.unionByName, parts)


def _tails(rows: DataFrame, level: int, smoothed: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """The rest of paths whose node (fewer than SUPPORT rows of it are here) has merged branches only from here on."""
    each = F.collect_list(F.struct("shape", "n", "labelled", "bad"))
    nodes = rows.groupBy("host", "node", "bad_share").agg(each.alias("g")).select("host", "node", "bad_share", "g", F.explode("g").alias("x"))

    def down(share: Column, k: Column) -> Column:
        deeper = F.filter("g", lambda y: F.size(y["shape"]) > k)
        total = lambda name: F.aggregate(deeper, F.lit(0).cast("long"), lambda a, y: a + y[name])
        return smoothed(total("bad"), total("labelled"), share)

    size = F.size("x.shape")
    share = F.aggregate(F.sequence(F.lit(level), size - 1), F.col("bad_share"), down)
    return nodes.select("host", F.col("x.shape").alias("shape"), F.col("x.n").alias("n"), F.concat("node", F.repeat(F.lit("/+"), size - level)).alias("template"), share.alias("bad_share"))


def judged(pages: DataFrame, rules: dict[str, str], url: str = "url", labels: str | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (``allow`` or ``block``), ``template`` and ``bad_share``.

    The rule that fits decides. Else the tree does, which learns from the urls that have a label: the column ``labels``
    (1 bad, 0 good, null none), or if it isn't given, the verdicts of the rules on the urls that they fit.

    Cases: a null url, or one without ``://``, has an empty host and path and is judged by the root of the empty
    host; hosts without labels have the smoothed share of all labels, one half if there are none; paths are followed to
    their last segment; repeated rows count each; an empty table gives no rows; columns named like the outputs are
    replaced, the others pass through.

    Urls are counted once, by host and shape, with partial sums on the map side. The tree is made from these counts, and
    each shape's template goes back to its urls by a join that spreads shapes which hold many of all urls.
    """
    outs = ("host", "path", "rule", "verdict", "template", "bad_share")
    m = marker(pages)
    of = lambda name: F.col(f"{m}{name}")
    label = None if labels is None else F.col(labels).cast("int")
    at = pages.withColumns({f"{m}host": host_of(F.col(url)), f"{m}path": path_of(F.col(url))}).withColumns({f"{m}fit": rule_of(of("host"), of("path"), rules), f"{m}shape": shape_of(of("path"))})
    at = at.withColumn(f"{m}bad", F.when(of("fit.verdict").isNotNull(), (of("fit.verdict") == "block").cast("int")) if label is None else label)
    shapes = written(at.groupBy(of("host").alias("host"), of("shape").alias("shape")).agg(F.count("*").alias("n"), F.count(of("bad")).alias("labelled"), F.coalesce(F.sum(of("bad")), F.lit(0)).alias("bad")))
    whole = shapes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    tree = written(template_tree(shapes, ((whole["bad"] or 0) + 1) / ((whole["labelled"] or 0) + 2)))
    found = spread_join(at, tree, {"host": of("host"), "shape": of("shape")}, {f"{m}template": "template", f"{m}share": "bad_share"}, "n", whole["n"] or 0, F.xxhash64(F.col(url)))
    verdict = F.coalesce(of("fit.verdict"), F.when(of("share") >= REJECTED, "block").otherwise("allow"))
    made = (of("host"), of("path"), of("fit.rule"), verdict, of("template"), of("share"))
    return found.select(*without(pages, *outs), *[x.alias(n) for n, x in zip(outs, made, strict=True)])
