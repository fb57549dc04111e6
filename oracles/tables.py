from oracles.base import (
    COURSES, DENSE, LATEST, LESSONS, LOGS, PRACTICES, PROGRESS, QUIZZES, ROLE_OF, ROLE_PERM, RUNS, SECTIONS, UNITS, with_,
)

CARDS = """cards AS (SELECT event_id AS card_id, CASE WHEN event_type <> 'signup' THEN user_id END AS user_id,
  event_id % 5 AS course_id, event_id % 25 AS unit_id, (user_id * 100 + event_id * 7 % 100) % (SELECT count(*) FROM orders) AS lesson_id,
  event_type IN ('click', 'signup') AS is_generated, ts AS created_at FROM events)"""
DST = """dst AS (SELECT c_custkey + 1000000 AS user_id, c_name AS email FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))"""
PERMS = "perms AS (SELECT DISTINCT user_id, permission FROM role_of JOIN role_perm USING (role))"
SNAP = """snap AS (SELECT run_id, log_id, sha256('{"run_id":' || run_id || ',"log_id":' || log_id || ',"stage":"' || stage
  || '","result":"' || result || '"}') AS row_sha FROM logs)"""

SQL = {
    "upsert_last_wins": with_(PROGRESS, LATEST, DENSE)
    + """SELECT user_id, lesson_id, coalesce(l.status, d.status) AS status
FROM dense d FULL JOIN latest l USING (user_id, lesson_id)""",
    "insert_if_absent": with_(PROGRESS, DENSE)
    + """SELECT user_id, lesson_id, false AS inserted FROM dense UNION ALL
SELECT DISTINCT user_id, lesson_id, true FROM progress p
WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.user_id = p.user_id AND d.lesson_id = p.lesson_id)""",
    "conditional_upsert": with_(PROGRESS, LATEST, DENSE)
    + """SELECT user_id, lesson_id, CASE WHEN l.status IS NULL THEN 'not_started'
  WHEN l.status = 'locked' AND d.status IS NOT NULL THEN 'not_started' ELSE l.status END AS status
FROM latest l FULL JOIN dense d USING (user_id, lesson_id)""",
    "cascade_delete": with_(COURSES, UNITS, SECTIONS, LESSONS, PRACTICES, QUIZZES)
    + """, live AS (SELECT section_id FROM sections WHERE unit_id NOT IN
  (SELECT unit_id FROM cunits JOIN courses USING (course_id) WHERE courses.title = 'ASIA'))
SELECT 'sections' AS table_name, section_id AS id FROM live
UNION ALL SELECT 'lessons', lesson_id FROM lessons SEMI JOIN live USING (section_id)
UNION ALL SELECT 'practices', practice_id FROM practices SEMI JOIN live USING (section_id)
UNION ALL SELECT 'quizzes', quiz_id FROM quizzes SEMI JOIN live USING (section_id)""",
    "promote_missing": "SELECT c_custkey AS user_id, c_name AS email FROM customer "
    "WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "rekey_roles": with_(DST)
    + "SELECT dst.user_id, c_mktsegment AS role FROM customer JOIN dst ON dst.email = c_name",
    "snapshot_before_delete": with_(LOGS, SNAP)
    + """, part AS (SELECT run_id, count(*) AS n, sha256(string_agg(row_sha, ',' ORDER BY row_sha)) AS sha
  FROM snap GROUP BY run_id, left(row_sha, 3))
SELECT run_id, sum(n)::BIGINT AS n_rows, sha256(string_agg(sha, ',' ORDER BY sha)) AS sha256 FROM part GROUP BY 1""",
    "restore_snapshot": with_(LOGS) + "SELECT run_id, log_id, stage, result FROM logs",
    "filter_by_key": with_(LESSONS) + "SELECT lesson_id, title FROM lessons WHERE section_id = 7",
    "filter_in": with_(LOGS, RUNS)
    + "SELECT log_id, run_id, stage FROM logs WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'failed')",
    "filter_optional_criteria": with_(CARDS)
    + "SELECT card_id, course_id, unit_id FROM cards WHERE is_generated AND user_id IS NULL AND course_id = 3",
    "filter_visible": with_(CARDS)
    + "SELECT card_id, user_id FROM cards WHERE user_id = 8 OR (user_id IS NULL AND unit_id = 3)",
    "filter_either_key": with_(CARDS, UNITS, LESSONS)
    + """SELECT card_id FROM cards WHERE unit_id IN (SELECT unit_id FROM cunits WHERE course_id = 2)
  OR lesson_id IN (SELECT lesson_id FROM lessons WHERE title = '1-URGENT')""",
    "search_by_name": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' "
    "ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20",
    "filter_like_contains": "SELECT page_id, url FROM pages WHERE url LIKE '%example.org%'",
    "filter_by_type": with_(LOGS) + "SELECT log_id, run_id FROM logs WHERE stage = 'enricher' AND result = 'error'",
    "filter_live": "SELECT event_id, ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00' AS live FROM events",
    "filter_stale": with_(LOGS, RUNS)
    + """SELECT run_id, CASE WHEN status = 'processing' THEN 'in_progress' ELSE status END AS status FROM runs
WHERE status IN ('pending', 'processing')
  AND CASE WHEN run_id % 4 <> 0 THEN updated_at ELSE created_at END < TIMESTAMP '2024-01-28 23:55:00'""",
    "join_many_to_many": with_(ROLE_OF, ROLE_PERM, PERMS) + "SELECT * FROM perms",
    "has_permission": with_(ROLE_OF, ROLE_PERM, PERMS)
    + "SELECT user_id, bool_or(permission IN ('1-URGENT', '*')) AS granted FROM perms GROUP BY 1",
    "nest_children": with_(ROLE_PERM)
    + """SELECT role, count(*)::INTEGER AS n, string_agg(permission, '|' ORDER BY permission) AS permissions
FROM role_perm GROUP BY role""",
    "join_bridge_ordered": with_(SECTIONS, LESSONS)
    + """SELECT unit_id, section_id, lesson_id FROM sections JOIN lessons USING (section_id)
ORDER BY section_id, created_at DESC, lesson_id DESC""",
    "latest_run_for_document": with_(LOGS, RUNS)
    + """SELECT doc_id, run_id, status FROM runs WHERE doc_id IN (SELECT doc_id FROM documents)
QUALIFY run_id = max(run_id) OVER (PARTITION BY doc_id)""",
    "max_id_per_key": with_(LOGS, RUNS) + "SELECT doc_id, max(run_id) AS run_id FROM runs GROUP BY 1",
    "latest_per_key": with_(PROGRESS)
    + """SELECT user_id, lesson_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS opened_at FROM progress
WHERE status NOT IN ('not_started', 'locked')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "order_content": with_(LESSONS)
    + "SELECT section_id, display_order, lesson_id, title FROM lessons ORDER BY 1, 2",
    "paginate": with_(LESSONS)
    + """SELECT lesson_id, title, (SELECT count(*) FROM lessons) AS total,
  CASE WHEN (SELECT count(*) FROM lessons) > 150 THEN 150::BIGINT END AS next_offset
FROM lessons ORDER BY lesson_id LIMIT 50 OFFSET 100""",
    "fifo_batch": with_(LOGS, RUNS) + "SELECT run_id FROM runs WHERE status = 'pending' ORDER BY run_id LIMIT 10",
    "sample_rows": with_(LESSONS)
    + "SELECT title, lesson_id FROM lessons QUALIFY row_number() OVER (PARTITION BY title ORDER BY lesson_id) <= 25",
    "union_all": with_(LESSONS, PRACTICES, QUIZZES)
    + """SELECT 'lesson' AS kind, lesson_id AS id, section_id FROM lessons
UNION ALL SELECT 'practice', practice_id, section_id FROM practices
UNION ALL SELECT 'quiz', quiz_id, section_id FROM quizzes""",
    "coverage": with_(LESSONS, PROGRESS)
    + """SELECT section_id, count(*) AS expected, count(*) FILTER (hit IS NULL) AS missing,
  CASE WHEN count(*) FILTER (hit IS NULL) = 0 THEN 'complete' WHEN count(hit) = 0 THEN 'empty' ELSE 'partial' END AS verdict
FROM lessons LEFT JOIN (SELECT DISTINCT lesson_id, 1 AS hit FROM progress) USING (lesson_id) GROUP BY 1""",
    "expand_ranges": with_(LOGS)
    + """, r AS (SELECT run_id, log_id, (log_id % 7)::INTEGER AS a,
  (log_id % 7 + floor(duration)::BIGINT % 5 - 1)::INTEGER AS b FROM logs)
SELECT run_id, page::INTEGER AS page, min(log_id) AS first_range FROM r, LATERAL (SELECT unnest(range(a, b + 1)) AS page)
GROUP BY 1, 2""",
    "target_keys": with_(LOGS)
    + """SELECT run_id, sha256('delete_document_process_runs|v1|process_ids='
  || string_agg(DISTINCT log_id % 3, ',' ORDER BY log_id % 3)) AS target_key FROM logs GROUP BY 1""",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso FROM events",
}
