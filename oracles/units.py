from oracles.annotations import ANNOTATED
from oracles.base import NODES, collapse, shorten, with_, words
from oracles.structure import FIXED

MEMBERS = """members AS (SELECT *, CASE WHEN node_type IN ('heading', 'figure', 'equation') THEN node_type
    WHEN node_type = 'question' THEN 'exercise' ELSE 'text' END AS role FROM (SELECT *, last_value(CASE WHEN node_type = 'heading'
    THEN node_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit_id
  FROM fixed WHERE node_type <> 'page_header') WHERE unit_id IS NOT NULL)"""
PROFILE = f"""counted AS (SELECT doc_id, unit_id, min(seq) AS seq, arg_min(text, seq) AS title, arg_min(level, seq) AS level,
  min(page) AS start_page, max(page) AS end_page, count(*) FILTER (role = 'text') AS n_text,
  count(*) FILTER (role = 'figure') AS n_figure, 0::BIGINT AS n_table, count(*) FILTER (role = 'equation') AS n_equation,
  count(*) FILTER (role = 'exercise') AS n_exercise,
  coalesce(sum({words("text")}) FILTER (role = 'text'), 0)::BIGINT AS words,
  arg_min(text, seq) FILTER (role = 'text') AS first_text FROM members GROUP BY 1, 2),
profile AS (SELECT * EXCLUDE (first_text, sc), coalesce({shorten("first_text", 200)}, '') AS description,
  greatest(1, round_even(words / 250.0::DOUBLE, 0)::BIGINT) + 3 * n_exercise + n_figure + n_equation AS minutes,
  CASE WHEN sc <= 3 THEN 'basic' WHEN sc <= 8 THEN 'intermediate' ELSE 'advanced' END AS difficulty
  FROM (SELECT *, 2 * n_equation + 3 * n_exercise + CASE WHEN n_text > 0 AND words / n_text > 50 THEN 4
    WHEN n_text > 0 AND words / n_text > 30 THEN 2 ELSE 0 END AS sc FROM counted))"""
TYPED = f"""typed_u AS (SELECT *, CASE WHEN level = 1 AND seq = min(CASE WHEN level = 1 THEN seq END) OVER (PARTITION BY doc_id) THEN 'course'
  WHEN fw IN ('chapter', 'unit', 'module', 'part') THEN 'module' WHEN fw IN ('lesson', 'section', 'topic', 'lab') THEN 'lesson'
  WHEN level <= 1 THEN 'module' WHEN level <= 2 THEN 'lesson' ELSE 'topic' END AS unit_type
  FROM (SELECT *, rtrim(lower(split_part({collapse("title")}, ' ', 1)), '.:') AS fw FROM profile))"""


def parents(order):
    return f"""ranked AS (SELECT *, CASE unit_type {order} END AS rk FROM typed_u),
units AS (SELECT u.*, (SELECT arg_max(p.unit_id, p.seq) FROM ranked p WHERE p.doc_id = u.doc_id AND p.seq < u.seq AND p.rk < u.rk
    AND NOT EXISTS (SELECT 1 FROM ranked b WHERE b.doc_id = p.doc_id AND b.seq > p.seq AND b.seq < u.seq AND b.rk <= p.rk)) AS parent_id
  FROM ranked u)"""


RANK = "WHEN 'course' THEN 0 WHEN 'module' THEN 1 WHEN 'lesson' THEN 2 ELSE 3"
LEX = "WHEN 'course' THEN 0 WHEN 'lesson' THEN 1 WHEN 'module' THEN 2 ELSE 3"
UTREE = """utree(doc_id, node, ancestor, distance) AS (SELECT doc_id, unit_id, unit_id, 0 FROM units
  UNION ALL SELECT t.doc_id, t.node, p.parent_id, t.distance + 1 FROM utree t JOIN units p ON p.unit_id = t.ancestor
  WHERE p.parent_id IS NOT NULL)"""
CTES = [NODES, FIXED, MEMBERS, PROFILE]
UNITS = [*CTES, TYPED, parents(RANK)]
ROLL = """roll AS (SELECT t.ancestor AS unit_id, count(*) - 1 AS descendants,
  count(*) FILTER (unit_type = 'lesson') AS lesson_count, sum(n_exercise)::BIGINT AS exercise_count,
  sum(minutes)::BIGINT AS total_minutes, min(start_page) AS start_page, max(end_page) AS end_page
  FROM utree t JOIN units u ON u.unit_id = t.node GROUP BY 1)"""


def w(*extra):
    return with_(*extra, recursive=True)


SQL = {
    "unit_table": w(*CTES) + "SELECT * FROM profile",
    "build_units": w(NODES, FIXED, MEMBERS) + "SELECT unit_id, node_id, role FROM members",
    "unit_study_time": w(*CTES) + "SELECT unit_id, words, minutes FROM profile",
    "unit_difficulty": w(*CTES) + "SELECT doc_id, difficulty, count(*) AS n FROM profile GROUP BY 1, 2",
    "unit_types": w(*CTES, TYPED) + "SELECT unit_id, unit_type FROM typed_u",
    "unit_parents": w(*UNITS) + "SELECT unit_id, unit_type, parent_id FROM units",
    "unit_parents_lexical": w(*CTES, TYPED, parents(LEX)) + "SELECT unit_id, parent_id FROM units",
    "scope_annotations_to_units": w(ANNOTATED, FIXED, MEMBERS)
    + """SELECT m.unit_id, a.node_id, CASE WHEN type = 'callout' THEN 'example' ELSE type END AS list_kind, ord,
  CASE type WHEN 'objective' THEN body WHEN 'definition' THEN a.term || ': ' || body
    ELSE coalesce(nullif(a.term, ''), left(body, 120)) END AS summary
FROM anns a JOIN members m USING (node_id)
WHERE (type = 'objective' AND body <> '') OR type IN ('definition', 'example') OR (type = 'callout' AND kind = 'example')""",
    "rollup_unit_tree": w(*UNITS, UTREE, ROLL) + "SELECT * FROM roll",
    "section_of_unit": w(*UNITS, UTREE)
    + """SELECT t.node AS unit_id, coalesce(arg_min(t.ancestor, t.distance) FILTER (u.unit_type = 'module'),
  arg_max(t.ancestor, t.distance)) AS section_id FROM utree t JOIN units u ON u.unit_id = t.ancestor GROUP BY 1""",
    "section_cards": w(*UNITS, UTREE, ROLL)
    + """SELECT m.unit_id, m.title, m.minutes, r.lesson_count, r.exercise_count, r.start_page, r.end_page,
  (SELECT count(*) FROM utree t JOIN units l ON l.unit_id = t.node WHERE t.ancestor = m.unit_id AND l.unit_type = 'lesson'
    AND l.words % 2 = 0) AS completed_count,
  (SELECT count(*) FROM utree t JOIN units l ON l.unit_id = t.node WHERE t.ancestor = m.unit_id AND l.unit_type = 'lesson'
    AND l.words % 3 <> 0) AS quiz_count
FROM units m JOIN roll r USING (unit_id) WHERE m.unit_type = 'module' AND r.lesson_count >= 1""",
    "navigation_order": w(*UNITS, UTREE)
    + """, paths AS (SELECT t.doc_id, t.node, list(u.seq ORDER BY t.distance DESC) AS path, max(t.distance)::INTEGER AS depth
  FROM utree t JOIN units u ON u.unit_id = t.ancestor GROUP BY 1, 2),
num AS (SELECT node AS unit_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS position, depth FROM paths)
SELECT * FROM num WHERE depth < 3""",
}
