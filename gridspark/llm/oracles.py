"""DuckDB SQL for the text operators that SQL can express."""

from gridspark.llm import decontamination, fim, repeats

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS whole FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL) JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
arcs AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, arcs.y FROM reach JOIN arcs ON arcs.x = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(class_id, doc_id) AS class_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

LINKS = f"""
WITH j AS MATERIALIZED ({JACCARD}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x, count(*) AS n_links FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL) JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c) GROUP BY x)
SELECT j.*, coalesce(n_links, 0)::BIGINT AS n_links FROM j LEFT JOIN l ON l.x = j.doc_id
"""

SEARCH = f"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
size AS (SELECT count(*) AS n, (SELECT count(*) FROM t) / count(*)::DOUBLE AS mean FROM documents),
tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS f FROM t GROUP BY ALL),
dl AS (SELECT doc_id, sum(f) AS l FROM tf GROUP BY ALL),
idf AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY w, n)
SELECT query_id, rank, doc_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM (
    SELECT q.doc_id AS query_id, tf.doc_id, round(sum(idf * tf.f * 2.2::DOUBLE / (tf.f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score
    FROM (SELECT DISTINCT doc_id, w FROM tf WHERE doc_id % 100 = 0) q JOIN tf USING (w) JOIN idf USING (w) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN size GROUP BY ALL))
WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op5_jaccard_join": LINKS, "op6_winnowing": decontamination.ORACLE, "op9_bm25_search": SEARCH, "op11_periodic_runs": repeats.ORACLE, "op13_fill_in_middle": fim.ORACLE}
