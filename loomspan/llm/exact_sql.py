"""DuckDB SQL that gives the rows of the join, the decontamination and the suffix dedup by plain means."""

from __future__ import annotations

#: All pairs of documents that share a five-word run, then reachability. It is for small tables.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
    FROM words WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM common JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9
), reach(x, y) AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x
), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(least(d.doc_id, least.y), d.doc_id) AS class_id, coalesce(n.n, 0) AS n_links
FROM documents d LEFT JOIN least ON least.x = d.doc_id LEFT JOIN n ON n.x = d.doc_id
"""

#: Equal tokens of documents and items, by diagonal; then every window of the diagonals that have enough.
DECONTAMINATE = r"""
WITH t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
    SELECT item_id, w, len(w) AS n, least(13, len(w)) AS width,
        CASE WHEN least(13, len(w)) >= 11 THEN floor(least(13, len(w)) * 0.2)::int ELSE 1 END AS allowed
    FROM i WHERE len(w) >= 8
), dt AS (SELECT doc_id, len(w) AS m, unnest(w) AS token, unnest(generate_series(0, len(w) - 1)) AS p FROM t
), it AS (SELECT item_id, n, width, allowed, unnest(w) AS token, unnest(generate_series(0, n - 1)) AS q FROM items
), rare AS (SELECT doc_id, m, p, it.* FROM dt JOIN it USING (token)
), diagonals AS (
    SELECT doc_id, m, item_id, n, width, allowed, p - q AS diagonal, list(q) AS hits FROM rare GROUP BY ALL HAVING count(*) >= width - allowed
), starts AS (
    SELECT *, unnest(generate_series(greatest(0, -diagonal), least(n, m - diagonal) - width)) AS s FROM diagonals WHERE least(n, m - diagonal) - greatest(0, -diagonal) >= width
), judged AS (
    SELECT doc_id, item_id, width, allowed, len(list_filter(hits, lambda q: q >= s AND q < s + width)) AS matched, s + diagonal AS doc_token, s AS item_token FROM starts
), best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_token, item_token) AS place FROM judged WHERE matched >= width - allowed
)
SELECT doc_id, item_id, matched::int AS matched, width::int AS width, doc_token::int AS doc_token, item_token::int AS item_token FROM best WHERE place = 1
"""

#: Every byte of every document is a row.
SUFFIX_DEDUP = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents
), bytes AS (SELECT doc_id, h, unnest(generate_series(0, octet_length(h) - 1)) AS p FROM raw WHERE octet_length(h) > 0
), windows AS (SELECT doc_id, p, CASE WHEN p + 50 <= octet_length(h) THEN hash(h[p + 1:p + 50]) END AS w, hex(h[p + 1:p + 1]) AS b FROM bytes
), least AS (SELECT w, min(doc_id) AS first_doc FROM windows WHERE w IS NOT NULL GROUP BY w
), hits AS (SELECT x.doc_id, p, b, coalesce(first_doc < x.doc_id, false) AS hit FROM windows x LEFT JOIN least USING (w)
), gone AS (SELECT doc_id, p, b, coalesce(max(CASE WHEN hit THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) > p - 50, false) AS gone FROM hits
), runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM gone
), told AS (
    SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
        coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
    FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM raw LEFT JOIN told USING (doc_id)
"""
