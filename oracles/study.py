from oracles.graph import PRE
from oracles.units import CTES, UNITS, UTREE, w

PLAN = """plan AS (SELECT doc_id, unit_id, title, difficulty, minutes, words,
  row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS position FROM profile)"""
BATCH = """batch(doc_id, position, difficulty, milestone, n) AS (SELECT doc_id, position, difficulty, 0::BIGINT, 1 FROM plan WHERE position = 0
  UNION ALL SELECT p.doc_id, p.position, p.difficulty,
    b.milestone + CASE WHEN b.n >= 4 OR (b.n >= 2 AND p.difficulty <> b.difficulty) THEN 1 ELSE 0 END,
    CASE WHEN b.n >= 4 OR (b.n >= 2 AND p.difficulty <> b.difficulty) THEN 1 ELSE b.n + 1 END
  FROM batch b JOIN plan p ON p.doc_id = b.doc_id AND p.position = b.position + 1),
batched AS (SELECT p.*, b.milestone FROM plan p JOIN batch b USING (doc_id, position))"""
SECTION = """sect AS (SELECT t.node AS unit_id, coalesce(arg_min(t.ancestor, t.distance) FILTER (u.unit_type = 'module'),
  arg_max(t.ancestor, t.distance)) AS section_id FROM utree t JOIN units u ON u.unit_id = t.ancestor GROUP BY 1)"""
CARDS = """cards AS (SELECT doc_id, unit_id, section_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS position, minutes,
  CASE WHEN difficulty = 'basic' THEN 'beginner' ELSE difficulty END AS difficulty,
  CASE words % 5 WHEN 0 THEN 'mastered' WHEN 1 THEN 'in_progress' ELSE 'not_started' END AS status, start_page, end_page
  FROM units JOIN sect USING (unit_id))"""
TOPO = """needs AS (SELECT doc_id, unit_id, list(prerequisite_id) AS needs FROM pre GROUP BY 1, 2),
ranked_u AS (SELECT doc_id, unit_id, seq, CASE difficulty WHEN 'advanced' THEN 2 WHEN 'intermediate' THEN 1 ELSE 0 END::BIGINT AS rank FROM units),
tg AS (SELECT p.doc_id, p.prerequisite_id AS unit_id, list({'u': p.unit_id, 'r': u.rank, 'needs': n.needs} ORDER BY p.unit_id) AS targets
  FROM pre p JOIN needs n USING (doc_id, unit_id) JOIN ranked_u u USING (doc_id, unit_id) GROUP BY 1, 2),
start AS (SELECT doc_id, list({'t': t, 'u': unit_id, 'r': rank} ORDER BY t) AS ready FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS t
  FROM ranked_u ANTI JOIN needs USING (doc_id, unit_id)) GROUP BY 1),
walk(doc_id, position, picked, ready, ticket, last, streak, done) AS (
  SELECT doc_id, -1::BIGINT, NULL::VARCHAR, ready, len(ready)::BIGINT, -1::BIGINT, 0::BIGINT, []::VARCHAR[] FROM start
  UNION ALL
  SELECT doc_id, position + 1, c.u, list_concat(list_filter(ready, lambda x: x.u <> c.u),
      list_transform(fresh, lambda y, i: {'t': ticket + i, 'u': y.u, 'r': y.r})), ticket + len(fresh),
    c.r, CASE WHEN c.r = last THEN streak + 1 ELSE 1 END, seen
  FROM (SELECT b.*, list_append(done, c.u) AS seen, coalesce(list_filter(tg.targets, lambda y: list_has_all(list_append(done, c.u), y.needs)), []) AS fresh
    FROM (SELECT *, list_sort(list_transform(ready, lambda x: {'s': CASE WHEN last < 0 THEN 0.0 ELSE -(CASE WHEN streak < 2 THEN 0.0
        WHEN x.r = last THEN -10.0 ELSE 5.0 END + (2 - x.r) * 0.5) END, 't': x.t, 'u': x.u, 'r': x.r}))[1] AS c FROM walk WHERE len(ready) > 0) b
    LEFT JOIN tg ON tg.doc_id = b.doc_id AND tg.unit_id = b.c.u))"""
SQL = {
    "balanced_topological_order": w(*UNITS, PRE, TOPO) + "SELECT doc_id, picked AS unit_id, position FROM walk WHERE position >= 0",
    "quiz_cards": w(*UNITS, UTREE, SECTION)
    + """SELECT 'q/' || unit_id AS quiz_id, section_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS position,
  n_exercise * 10 AS total_points, CASE WHEN words % 2 = 0 THEN 'completed' ELSE 'not_started' END AS status,
  CASE WHEN words % 2 = 0 THEN (words % 100)::DOUBLE END AS score FROM units JOIN sect USING (unit_id) WHERE n_exercise > 0""",
    "group_milestones": w(*CTES, PLAN, BATCH) + "SELECT unit_id, milestone FROM batched",
    "classify_lessons": w(*CTES, PLAN)
    + """SELECT unit_id, position, CASE WHEN difficulty = 'advanced' THEN 'advanced' WHEN position = 0 THEN 'introduction'
  WHEN position = max(position) OVER (PARTITION BY doc_id) THEN 'review' ELSE 'core' END AS lesson_type FROM plan""",
    "plan_totals": w(*CTES, PLAN, BATCH)
    + """SELECT doc_id, milestone, count(*) AS lessons, sum(minutes)::BIGINT AS minutes,
  greatest(5, sum(minutes) // 4)::BIGINT AS checkpoint_minutes,
  CASE WHEN bool_or(difficulty = 'advanced') THEN 'practice' WHEN bool_or(difficulty = 'intermediate') THEN 'quiz' ELSE 'self_test' END
    AS checkpoint_type,
  'Milestone ' || (milestone + 1) || ': ' || CASE WHEN count(DISTINCT difficulty) = 1
    THEN upper(min(difficulty)[1]) || min(difficulty)[2:] ELSE 'Mixed difficulty' END || ' topics' AS description
FROM batched GROUP BY doc_id, milestone""",
    "milestone_status": w(*CTES, PLAN, BATCH)
    + """SELECT doc_id, milestone, count(*) AS lesson_count, count(*) FILTER (words % 2 = 0) AS completed,
  CASE WHEN count(*) = count(*) FILTER (words % 2 = 0) THEN 'mastered' WHEN count(*) FILTER (words % 2 = 0) > 0 THEN 'in_progress'
    ELSE 'not_started' END AS status FROM batched GROUP BY 1, 2""",
    "progress_summary": w(*CTES, PLAN)
    + """SELECT doc_id, count(*) AS total_items, count(*) FILTER (words % 2 = 0) AS completed_items,
  round_even(count(*) FILTER (words % 2 = 0) / count(*) * 100, 2) AS mastery_pct,
  coalesce(sum(minutes) FILTER (words % 2 = 0), 0)::BIGINT AS studied_minutes,
  greatest(0, sum(minutes) - coalesce(sum(minutes) FILTER (words % 2 = 0), 0))::BIGINT AS remaining_minutes FROM plan GROUP BY 1""",
    "order_by_strategy": w(*CTES, PLAN) + "SELECT unit_id, difficulty FROM plan",
    "lesson_cards": w(*UNITS, UTREE, SECTION, CARDS) + "SELECT * EXCLUDE (doc_id) FROM cards",
    "apply_study_config": w(*UNITS, UTREE, SECTION, CARDS)
    + """SELECT unit_id, first_value(unit_id) OVER (PARTITION BY doc_id ORDER BY position) AS section_id, title, position,
  NULL::BIGINT AS minutes, NULL::VARCHAR AS difficulty, status, start_page, end_page FROM cards""",
    "apply_study_config_linear": w(*UNITS, UTREE, SECTION, CARDS) + "SELECT * EXCLUDE (doc_id) FROM cards",
    "practice_cards": w(*UNITS, UTREE, SECTION)
    + """SELECT s.section_id, m.node_id, m.text AS title,
  row_number() OVER (PARTITION BY m.doc_id ORDER BY h.seq, m.seq) - 1 AS position,
  CASE WHEN length(m.text) % 3 = 0 THEN 'practiced' ELSE 'not_started' END AS status,
  CASE WHEN length(m.text) % 3 = 0 THEN length(m.text) % 4 ELSE 0 END::BIGINT AS attempts,
  CASE WHEN length(m.text) % 3 = 0 THEN length(m.text) % 10 ELSE 0 END::DOUBLE AS best_score
FROM members m JOIN sect s USING (unit_id) JOIN units h ON h.unit_id = s.section_id WHERE m.role = 'exercise'""".replace(
        "ELSE 0 END::", "ELSE 0 END)::").replace("CASE WHEN length(m.text) % 3 = 0 THEN length", "(CASE WHEN length(m.text) % 3 = 0 THEN length"),
}
