"""DuckDB SQL for the url filter: the urls walk down the tree together, a level in each step of a recursion."""

from __future__ import annotations


def sql(rules: dict[str, str]) -> str:
    listed = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in rules.items())
    return rf"""WITH RECURSIVE rules(h, p, rule, verdict) AS (VALUES {listed}),
u AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hit AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS said FROM u, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i),
a AS (SELECT i, page_id, host, path, rule, said, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM u LEFT JOIN hit USING (i)),
w AS (SELECT (coalesce(sum(bad), 0) + 1) / (count(bad) + 2) AS share FROM a),
walk(i, page_id, host, path, rule, said, bad, segs, k, node, bad_share) AS (
  SELECT i, page_id, host, path, rule, said, bad, segs, 0, '', (coalesce(sum(bad) OVER h, 0) + 4.0 * (SELECT share FROM w)) / (count(bad) OVER h + 4.0)
  FROM a WINDOW h AS (PARTITION BY host)
  UNION ALL
  SELECT i, page_id, host, path, rule, said, bad, segs, k + 1, node || '/' || branch,
    (coalesce(sum(bad) OVER b, 0) + 4.0 * bad_share) / (count(bad) OVER b + 4.0)
  FROM (SELECT *, CASE WHEN labelled > 0 AND abs(n_bad - labelled * rate) >= 2.0 * sqrt(labelled * rate * (1 - rate)) THEN shape ELSE '+' END AS branch
    FROM (SELECT *, coalesce(sum(bad) OVER s, 0) AS n_bad, count(bad) OVER s AS labelled, (coalesce(sum(bad) OVER (PARTITION BY host, node), 0) + 1) / (count(bad) OVER (PARTITION BY host, node) + 2) AS rate
      FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY host, node, seen) < 5 AND NOT starts_with(seen, '*') THEN '*' ELSE seen END AS shape
        FROM (SELECT *, CASE WHEN regexp_matches(segs[k + 1], '[0-9]') THEN '*' || regexp_extract(segs[k + 1], '(\.[A-Za-z]+)$', 1) ELSE segs[k + 1] END AS seen
          FROM walk WHERE k < len(segs)))
      WINDOW s AS (PARTITION BY host, node, shape)))
  WINDOW b AS (PARTITION BY host, node, branch))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad_share >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict, node AS template FROM walk WHERE k = len(segs)"""
