"""SQL for the operators whose results SQL can express on whole tables."""

from __future__ import annotations

#: Every pair of one label; components by recursion over links.
_REACH = """reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a)"""

OP6 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH}, c AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

OP7 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
{_REACH}, c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m, d.doc_id)) AS BIGINT) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

OP10 = r"""WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM r GROUP BY source),
o AS (SELECT *, 1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(w) OVER (ORDER BY 2.0 * n / w DESC, source DESC) AS open_ FROM s),
f AS (SELECT *, 2 * n * open_ <= left_ * w AS full_ FROM o),
t AS (SELECT source, n, CASE WHEN full_ THEN CAST(2 * n AS DOUBLE) ELSE (SELECT max(left_) FILTER (WHERE NOT full_) FROM f) / (SELECT sum(w) FROM f WHERE NOT full_) * w END AS target FROM f),
b AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target / n) AS BIGINT) END AS times FROM t),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS k FROM r GROUP BY ALL),
u AS (SELECT *, sum(k) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT u.source, h, times < 2 AND (upto <= target - times * n OR (upto - k <= target - times * n AND k - (target - times * n - (upto - k)) < target - times * n - (upto - k))) AS once FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, target, CAST(size * (times + CASE WHEN once THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source JOIN e ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.h"""

SQL = {"op6_embedding_dedup": OP6, "op7_minhash_dedup": OP7, "op10_mixing": OP10}
