"""The queries in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], chr(31)) AS gram FROM d, unnest(range(1, greatest(len(w) - 3, 1))) t(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, unnest(range(0, 5)) t(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 20 * n_words THEN 16 ELSE 0 END AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 23 = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM f
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST(concat('0x', substring(md5(concat_ws('|', CAST(doc_id AS VARCHAR), source)), 1, 15)) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS place FROM s),
w AS (SELECT source, source_size, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CASE place WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope, source_size * 2.0::DOUBLE AS cap FROM k),
v AS (SELECT *, cap / weight AS full_at, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, (SELECT level FROM v WHERE level <= full_at ORDER BY full_at, level LIMIT 1) * weight) AS target FROM v),
o AS (SELECT d.*, source_size, target, slope, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw % 4096, draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(greatest(0, least(size, floor(target) - start)) AS BIGINT) AS one, CAST(greatest(0, least(size, floor(target) - (start + source_size))) AS BIGINT) AS two, least(1.0::DOUBLE, start / target) AS y1, least(1.0::DOUBLE, (start + source_size) / target) AS y2 FROM o)
SELECT doc_id, size, source_size, target, one + two AS taken,
  CASE WHEN one > 0 THEN CASE WHEN slope = 0 THEN y1 ELSE ((slope - 1.0::DOUBLE) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + slope * y1 * 4.0::DOUBLE)) / (slope * 2.0::DOUBLE) END END AS first_position,
  CASE WHEN two > 0 THEN CASE WHEN slope = 0 THEN y2 ELSE ((slope - 1.0::DOUBLE) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + slope * y2 * 4.0::DOUBLE)) / (slope * 2.0::DOUBLE) END END AS second_position FROM p
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], chr(31)) AS shingle FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)),
r AS (SELECT doc_id AS node, doc_id AS home FROM documents UNION SELECT e.y, r.home FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, h.home AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(home) AS home FROM r GROUP BY node) h ON h.node = d.doc_id
"""

OP1 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, hash(b[i:i+399]) AS h FROM d, unnest(range(1, n - 398)) t(i)),
t AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM p SEMI JOIN t USING (h)),
k AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 399 AS z FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
r AS (SELECT q.doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS kept, max(z) AS last FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256, CAST(length(regexp_replace(rest, '[89AB].|(.).', '\1', 'g')) AS BIGINT) AS n_kept_chars FROM (
  SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    concat(coalesce(kept, ''), hex(b[coalesce(last, 0) + 1:n])) AS rest FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) x GROUP BY r, doc_id, len(w), term),
f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
t AS (SELECT q, item_id, unnest(w) AS term FROM i),
v AS (SELECT q, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
      FROM t JOIN f USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM v WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""

ORACLES = {"op11_lexical_search": OP11, "op1_suffix_dedup": OP1, "op4_jaccard_join": OP4, "op8_quality_rules": OP8, "op9_mixing": OP9}
