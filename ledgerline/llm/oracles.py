"""SQL for the operators that it can express beside those with SQL in their own modules: brute force in DuckDB."""

REPEATS = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20
), k AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS win FROM i
), d AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS nth FROM k
), x AS (SELECT doc_id, list(s ORDER BY s) AS gone FROM d WHERE nth > 1 GROUP BY doc_id
), p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), z AS (SELECT doc_id, s, unnest(range(s, s + 20)) AS pos FROM d WHERE nth > 1
), q AS (SELECT DISTINCT doc_id, pos FROM z
), f AS (SELECT p.doc_id, count(*) AS n_words, count(q.pos) AS n_removed, string_agg(CASE WHEN q.pos IS NULL THEN word END, ' ' ORDER BY p.pos) AS kept FROM p LEFT JOIN q ON p.doc_id = q.doc_id AND p.pos = q.pos GROUP BY p.doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL
), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v
), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95
), r(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.low FROM r JOIN e ON r.id = e.a
), k AS (SELECT a, count(*) AS c FROM e GROUP BY a)
SELECT r.id AS vec_id, coalesce(max(k.c), 0) AS n_links, min(r.low) AS component_id, min(r.low) = r.id AS kept FROM r LEFT JOIN k ON k.a = r.id GROUP BY r.id
"""

SIMILAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON r.id = e.a)
SELECT r.id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.low) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
