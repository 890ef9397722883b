"""DuckDB SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

CATEGORY = """CASE regexp_replace(lower(label), '[^\\p{L}\\p{N}]', '', 'g')
    WHEN 'async' THEN 'Async' WHEN 'asyncwait' THEN 'Async'
    WHEN 'conc' THEN 'Conc' WHEN 'concurrency' THEN 'Conc' WHEN 'time' THEN 'Time'
    WHEN 'uc' THEN 'UC' WHEN 'unorderedcollections' THEN 'UC' WHEN 'unorderedcollection' THEN 'UC'
    WHEN 'od' THEN 'OD' WHEN 'orderdependency' THEN 'OD' WHEN 'testorderdependency' THEN 'OD'
    WHEN 'nonflaky' THEN 'Non-Flaky' END"""

P1_FOUND = f"""
WITH have AS (SELECT {CATEGORY} AS category, count(*) AS n FROM dataset GROUP BY 1),
total AS (SELECT count(*) AS total FROM dataset)
SELECT t.plan, t.category
FROM label_target t CROSS JOIN total LEFT JOIN have h ON h.category = t.category
WHERE coalesce(h.n, 0) < greatest(round(t.target_share * floor(round(t.sample_share * total, 6)), 6), CAST(t.min_rows AS DOUBLE))
"""

P1_REPORT = f"""
WITH have AS (SELECT {CATEGORY} AS category, count(*) AS n FROM dataset GROUP BY 1),
total AS (SELECT count(*) AS total FROM dataset),
need AS (SELECT t.plan, t.category, greatest(round(t.target_share * floor(round(t.sample_share * total, 6)), 6), CAST(t.min_rows AS DOUBLE)) AS need, coalesce(h.n, 0) AS available
  FROM label_target t CROSS JOIN total LEFT JOIN have h ON h.category = t.category)
SELECT *, greatest(need - available, 0.0::DOUBLE) AS missing, available < need AS shortfall, TRUE AS kept FROM need
"""

P3_FOUND = r"""
WITH names AS (
  SELECT DISTINCT project,
    regexp_replace(regexp_replace(lower(project), '[.](git|hg|svn|bzr|cvs)[^\p{L}\p{N}]*$', ''), '[^\p{L}\p{N}]', '', 'g') AS key
  FROM dataset WHERE project IS NOT NULL)
SELECT a.project AS project_a, b.project AS project_b
FROM names a JOIN names b ON a.key = b.key AND a.key <> '' AND a.project < b.project
"""


P3_WHOLE = r"""
WITH keys AS (SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(project), '[.](git|hg|svn|bzr|cvs)[^\p{L}\p{N}]*$', ''), '[^\p{L}\p{N}]', '', 'g'), ''), 'raw:' || project, 'null:') AS entity FROM dataset)
SELECT plan, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, TRUE AS whole FROM keys CROSS JOIN (SELECT DISTINCT plan FROM split_target) GROUP BY plan
"""


def _words(text: str) -> str:
    return f"""words AS (SELECT id, split, w, count(*) AS n FROM (SELECT id, split, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM dataset) GROUP BY ALL),
size AS (SELECT id, sum(n) AS n FROM words GROUP BY id)"""


P5_FOUND = f"""
WITH RECURSIVE {_words("coalesce(test_name, '') || chr(10) || coalesce(code, '')")},
pairs AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
alike AS (SELECT a, b FROM pairs JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE shared >= 0.75 * greatest(x.n, y.n)),
edges AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT a AS id_a, b AS id_b FROM reach WHERE a < b
"""

P5_GROUPS = f"""
WITH RECURSIVE {_words("coalesce(test_name, '') || chr(10) || coalesce(code, '')")},
bags AS (SELECT id, string_agg(w || '=' || n, ' ' ORDER BY w) AS bag FROM words GROUP BY id),
classes AS (SELECT id, min(id) OVER (PARTITION BY bag) AS class_id FROM bags),
reps AS (SELECT words.* FROM words JOIN classes USING (id) WHERE id = class_id),
pairs AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM reps a JOIN reps b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
alike AS (SELECT a, b FROM pairs JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE shared >= 0.75 * greatest(x.n, y.n)),
edges AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT d.id, coalesce(c.class_id, d.id) AS class_id, least(coalesce(c.class_id, d.id), coalesce(l.low, c.class_id, d.id)) AS group_id, coalesce(g.n, 0) AS n_links
FROM dataset d LEFT JOIN classes c ON c.id = d.id LEFT JOIN lowest l ON l.a = c.class_id LEFT JOIN degree g ON g.a = c.class_id
"""

P6_PAIRS = f"""
WITH {_words("coalesce(code, '')")},
pairs AS (SELECT a.id AS h, b.id AS t, sum(least(a.n, b.n)) AS shared FROM words a JOIN words b ON a.w = b.w AND a.split IN ('valid', 'test') AND b.split = 'train' GROUP BY ALL),
found AS (SELECT h, t, (shared / x.n)::DOUBLE AS containment FROM pairs JOIN size x ON x.id = h WHERE shared >= 0.8 * x.n)
"""
P6_FOUND = P6_PAIRS + "SELECT DISTINCT least(h, t) AS id_a, greatest(h, t) AS id_b FROM found"
P6_OVERLAPS = P6_PAIRS + "SELECT h AS id_h, t AS id_t, d.split, containment, d.project FROM found JOIN dataset d ON d.id = h"
P6_COUNTS = P6_PAIRS + "SELECT d.split, d.project, count(DISTINCT h) AS n_records, count(*) AS n_overlaps FROM found JOIN dataset d ON d.id = h GROUP BY ALL"

P7_MEASURE = r"""
WITH plain AS (SELECT item_id, regexp_replace(lower(regexp_replace(coalesce(output, ''), '(?m)^[ \t]*[(（]?\d+[.)）、．:：][ \t]*', '', 'g')), '[^\p{L}\p{N}]', '', 'g') AS s FROM alpaca_item),
grams AS (SELECT item_id, i, substr(s, i, 30) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 28)) AS i FROM plain)),
again AS (SELECT item_id, i FROM grams QUALIFY row_number() OVER (PARTITION BY item_id, g ORDER BY i) > 1),
covered AS (SELECT item_id, sum(least(30, coalesce(later - i, 30))) AS n FROM (SELECT item_id, i, lead(i) OVER (PARTITION BY item_id ORDER BY i) AS later FROM again) GROUP BY item_id),
measured AS (SELECT item_id, length(s)::BIGINT AS n_chars, coalesce(n, 0) / greatest(length(s), 1)::DOUBLE AS repeated_share FROM plain LEFT JOIN covered USING (item_id))
SELECT item_id, n_chars, repeated_share, repeated_share >= 0.4 AS bad FROM measured
"""
P7_FOUND = f"SELECT item_id FROM ({P7_MEASURE}) WHERE bad"

P8_FITS = "SELECT spec_id, (capacity_tokens - reserved_tokens)::BIGINT AS room, (SELECT count(*) FROM documents) AS n_docs, TRUE AS fits FROM container_spec"

P9_FOUND = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS u FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') FROM eval_item WHERE lang NOT IN ('zh', 'ja')),
wg AS (SELECT kind, id, array_to_string(u[i : i + 11], ' ') AS g FROM (SELECT kind, id, u, unnest(range(1, len(u) - 10)) AS i FROM words)),
chars AS (SELECT 'd' AS kind, doc_id AS id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM documents
  UNION ALL SELECT 'i', item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') FROM eval_item WHERE lang IN ('zh', 'ja')),
cg AS (SELECT kind, id, substr(s, i, 30) AS g FROM (SELECT kind, id, s, unnest(range(1, length(s) - 28)) AS i FROM chars))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM wg d JOIN wg i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i'
UNION SELECT DISTINCT d.id, i.id FROM cg d JOIN cg i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i'
"""


# the last visible character of every document that has one
P10_EXTENT = r"""
WITH seen AS (SELECT doc_id, length(regexp_replace(text, '[\x{09}-\x{0D}\x{20}\x{A0}\x{2009}\x{200B}\x{200E}\x{200F}\x{202F}\x{2060}\x{3000}\x{FEFF}]+$', '')) AS n FROM documents)
SELECT doc_id, n::INT AS end_pos, TRUE AS chained FROM seen WHERE n > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_report": P1_REPORT,
        "p3_found": P3_FOUND,
        "p3_whole": P3_WHOLE,
        "p5_found": P5_FOUND,
        "p5_groups": P5_GROUPS,
        "p6_found": P6_FOUND,
        "p6_overlaps": P6_OVERLAPS,
        "p6_counts": P6_COUNTS,
        "p7_found": P7_FOUND,
        "p7_measure": P7_MEASURE,
        "p8_fits": P8_FITS,
        "p9_found": P9_FOUND,
        "p10_extent": P10_EXTENT,
    }
