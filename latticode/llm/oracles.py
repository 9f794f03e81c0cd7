"""The text queries as SQL for DuckDB, where SQL can express them."""

#: Words of a text, as in every contract; null has none.
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"

OP8 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER o1, 0))
             / sum(weight) OVER o2 AS level
      FROM w WINDOW o1 AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    o2 AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT arg_min(level, source_size / weight) AS final FROM v WHERE level * weight < 2 * source_size),
t AS (SELECT source, source_size,
             CASE WHEN source_size = 0 THEN 0 ELSE least(2.0::DOUBLE * source_size, coalesce(final * weight, 2.0::DOUBLE * source_size)) END AS target
      FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
             CAST('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

OP9 = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p WHERE i + 34 <= len(w)),
m AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM h SEMI JOIN m USING (h)),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept
      FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP10 = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 85 * (u.n + v.n - k)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
p AS (SELECT doc_id, t, unnest(range(0, CAST(len(t) / 2 AS BIGINT))) AS i FROM d),
h AS (SELECT doc_id, i, md5(substr(t, 2 * i + 1, 100)) AS h FROM p WHERE 2 * i + 100 <= len(t)),
m AS (SELECT h, min(doc_id) AS f FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT DISTINCT doc_id, i FROM h JOIN m USING (h) WHERE f < doc_id),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM s),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM
      (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS c, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
k AS (SELECT o.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
             string_agg(substr(t, 2 * c + 1, 2 * (a - c)) || CASE WHEN k = n THEN substr(t, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
      FROM o JOIN d ON o.doc_id = d.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(t) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, t))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

OP13 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
g AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM g GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT l.lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total
      FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k ON l.lang = k.lang GROUP BY l.lang),
s AS (SELECT x.lang, x.source, v, lang_total, coalesce(total, 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) x JOIN v ON x.lang = v.lang
      LEFT JOIN (SELECT g.lang, source, sum(n) AS total FROM g JOIN k USING (lang, term) GROUP BY ALL) y
             ON x.lang = y.lang AND x.source = y.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(g.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(g.n, 0) + 2)) // (total + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
      FROM s JOIN k ON s.lang = k.lang LEFT JOIN g ON g.lang = s.lang AND g.source = s.source AND g.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""

SQL = {"op11_fill_middle": OP11, "op13_divergence": OP13,
       "op4_suffix_dedup": OP4, "op10_jaccard_join": OP10,
       "op6_substring_dedup": OP6, "op8_mixing": OP8, "op9_exact_dedup": OP9}
