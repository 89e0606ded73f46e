"""The same results in DuckDB SQL, for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * (length(t) - length(replace(t, '!!', '!'))) > 3 * n_words
            OR 10 * n_dup_lines > 3 * len(string_split(t, chr(10))) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > length(t) OR 10 * length(regexp_replace(t, '[^0-9]+', '', 'g')) > 3 * length(t)
            OR 5 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > n_words) AS kept
FROM j"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN k USING (vec_id)"""

OP6 = rf"""
WITH RECURSIVE sz AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, count(CASE WHEN size > 0 THEN 1 END) AS n FROM sz GROUP BY 1),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * ss / w AS ratio, CAST(sum(ss) OVER () AS DOUBLE) AS every,
              CAST(sum(ss) OVER o - ss AS DOUBLE) AS before, CAST(sum(w) OVER () - sum(w) OVER o + w AS DOUBLE) AS free
       FROM s1 WINDOW o AS (ORDER BY 2.0::DOUBLE * ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT coalesce(min_by((1.5::DOUBLE * every - 2.0::DOUBLE * before) / free, ratio), 1e300::DOUBLE) AS level FROM s2
       WHERE (1.5::DOUBLE * every - 2.0::DOUBLE * before) / free <= ratio),
tg AS (SELECT source, ss, n, least(2.0::DOUBLE * ss, w * level) AS target FROM s2, lv),
t1 AS (SELECT *, CAST(floor(target / ss) AS BIGINT) AS copies, target - floor(target / ss) * ss AS rest FROM tg WHERE ss > 0),
d1 AS (SELECT doc_id, size, t1.*, ss / CAST(ss + n * size AS DOUBLE) AS lean FROM sz JOIN t1 ON sz.source IS NOT DISTINCT FROM t1.source WHERE size > 0),
d2 AS (SELECT *, rest * 1000 / sum(CAST(round(lean * size * 1000) AS BIGINT)) OVER (PARTITION BY source) AS scale,
              (CAST('0x' || md5('7:' || doc_id)[1:12] AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
              pow(2.0::DOUBLE, greatest(0, ceil(log2(n / 4096.0::DOUBLE)))) AS buckets FROM d1),
d3 AS (SELECT *, least(1.0::DOUBLE, scale * lean) AS p FROM d2),
d4 AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM d3),
d5 AS (SELECT *, floor(odds / (1 + odds) * buckets) AS bucket, CAST(doc_id AS VARCHAR) AS key FROM d4 WHERE odds IS NOT NULL),
d6 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, key ROWS UNBOUNDED PRECEDING) <= rest AS inside,
              sum(size) OVER (PARTITION BY source ORDER BY odds, key ROWS UNBOUNDED PRECEDING) AS reached FROM d5),
cut AS (SELECT source, any_value(rest) - coalesce(max(CASE WHEN inside THEN reached END), 0) AS gap,
               min(CASE WHEN NOT inside THEN bucket END) AS met FROM d6 GROUP BY 1),
bh AS (SELECT d6.source, d6.doc_id, d6.size, odds, key,
              row_number() OVER (PARTITION BY d6.source ORDER BY d6.size DESC, odds DESC, key DESC) AS i
       FROM d6 JOIN cut ON d6.source IS NOT DISTINCT FROM cut.source AND bucket = met WHERE NOT inside),
g AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(gap AS DOUBLE) AS gap, CAST(NULL AS BIGINT) AS doc FROM cut
      UNION ALL SELECT g.source, b.i, CASE WHEN b.size <= g.gap THEN g.gap - b.size ELSE g.gap END, CASE WHEN b.size <= g.gap THEN b.doc_id END
      FROM g JOIN bh b ON b.source IS NOT DISTINCT FROM g.source AND b.i = g.i + 1),
left_over AS (SELECT source, min(gap) AS gap FROM g GROUP BY 1),
ov AS (SELECT arg_min(doc_id, (b.size, odds, key)) AS doc FROM bh b JOIN left_over f ON b.source IS NOT DISTINCT FROM f.source
       WHERE b.size > f.gap AND b.size < 2 * f.gap GROUP BY b.source),
more AS (SELECT doc_id FROM d6 WHERE inside UNION SELECT doc FROM g WHERE doc IS NOT NULL UNION SELECT doc FROM ov)
SELECT sz.doc_id, sz.size, tg.ss AS source_size, tg.target,
       CAST(CASE WHEN sz.size > 0 THEN floor(tg.target / tg.ss) + CASE WHEN more.doc_id IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END * sz.size AS BIGINT) AS taken
FROM sz JOIN tg ON sz.source IS NOT DISTINCT FROM tg.source LEFT JOIN more ON more.doc_id = sz.doc_id"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d),
s AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM b),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT b.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM b JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

WHOLE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP11 = f"""
WITH {WHOLE},
m AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM m a JOIN m b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

OP13 = f"""
WITH {WHOLE},
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

SQL = {"op11_hard_negatives": OP11, "op13_approximation_search": OP13, "op2_quality_rules": OP2, "op3_lattice_dedup": OP3, "op6_mixing": OP6, "op9_ngram_join": OP9}
