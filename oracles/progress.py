from oracles.base import (
    ATTEMPTS, DENSE, LATEST, LESSONS, PRACTICES, PROGRESS, QUIZ_RESULTS, QUIZZES, SECTIONS, UNITS, with_,
)
from oracles.tables import CARDS

ENROLLED = """enrolled AS (SELECT DISTINCT user_id, section_id FROM progress JOIN lessons USING (lesson_id))"""


def sidebar(v):
    return f"""CASE WHEN {v} = 'mastered' THEN 'completed' WHEN {v} IN ('practiced', 'familiar', 'attempted')
  THEN 'in_progress' ELSE 'not_started' END"""


def action(v):
    return f"""CASE WHEN {v} = 'mastered' THEN 'Review' WHEN {v} IN ('attempted', 'practiced', 'familiar')
  THEN 'Continue' ELSE 'Start' END"""


def duration(m):
    return f"""CASE WHEN {m} <= 0 THEN '' WHEN {m} < 60 THEN {m} || ' min' WHEN {m} % 60 = 0 THEN {m} // 60 || ' hr'
  ELSE {m} // 60 || ' hr ' || {m} % 60 || ' min' END"""


LESSON_ROWS = """lesson_rows AS (SELECT e.user_id, e.section_id, l.lesson_id AS item_id, l.title, l.display_order, l.minutes,
  CASE WHEN p.status = 'locked' THEN 'locked' WHEN p.completed_at IS NOT NULL THEN 'mastered'
    WHEN p.status = 'in_progress' THEN 'attempted' WHEN p.status = 'viewed' THEN 'familiar' ELSE 'not_started' END AS status
  FROM enrolled e JOIN lessons l USING (section_id)
  LEFT JOIN latest p ON p.user_id = e.user_id AND p.lesson_id = l.lesson_id)"""
TOTALS = """totals AS (SELECT user_id, practice_id, attempts, best_score,
  CASE WHEN (required_correct > 0 AND last >= required_correct) OR (required_correct <= 0 AND last > 0)
    THEN 'mastered' ELSE 'attempted' END AS status
  FROM (SELECT user_id, practice_id, count(*) AS attempts, max(score) AS best_score, arg_max(score, event_id) AS last
    FROM attempts GROUP BY 1, 2) JOIN practices USING (practice_id))"""
PRACTICE_ROWS = """practice_rows AS (SELECT e.user_id, e.section_id, p.practice_id AS item_id, p.title, p.display_order,
  coalesce(t.attempts, 0) AS attempts, coalesce(t.best_score, 0.0::DOUBLE) AS best_score,
  CASE WHEN p.required_correct > 0 AND t.best_score >= p.required_correct THEN 'mastered'
    WHEN t.attempts > 0 THEN 'practiced' ELSE 'not_started' END AS status,
  'Score ' || p.required_correct || '/10 to pass' AS progress_label
  FROM enrolled e JOIN practices p USING (section_id)
  LEFT JOIN totals t ON t.user_id = e.user_id AND t.practice_id = p.practice_id)"""
QUIZ_ROWS = """quiz_rows AS (SELECT e.user_id, e.section_id, q.quiz_id AS item_id, q.title, r.score,
  CASE WHEN r.score >= 70 THEN 'mastered' WHEN r.score IS NOT NULL THEN 'attempted' ELSE 'not_started' END AS status,
  CASE WHEN r.completed_at IS NOT NULL THEN 'mastered' WHEN r.score IS NOT NULL THEN 'attempted'
    ELSE 'not_started' END AS goal_status
  FROM enrolled e JOIN quizzes q USING (section_id)
  LEFT JOIN quiz_results r ON r.user_id = e.user_id AND r.quiz_id = q.quiz_id)"""
SQUARES = """squares AS (SELECT user_id, section_id, 'lesson' AS kind, item_id, display_order, status FROM lesson_rows
  UNION ALL SELECT user_id, section_id, 'practice', item_id, display_order, status FROM practice_rows
  UNION ALL SELECT user_id, section_id, 'quiz', item_id, 0, goal_status FROM quiz_rows)"""
BASE = with_(
    PROGRESS, LATEST, SECTIONS, LESSONS, PRACTICES, QUIZZES, ATTEMPTS, QUIZ_RESULTS, ENROLLED,
    LESSON_ROWS, TOTALS, PRACTICE_ROWS, QUIZ_ROWS, SQUARES,
)
COMPLETE = """complete AS (SELECT user_id, section_id, count(*) FILTER (status = 'mastered') AS mastered,
  any_value(total) AS total, count(*) FILTER (status = 'mastered') >= any_value(total) AS complete
  FROM dense JOIN (SELECT section_id, count(*) AS total FROM lessons GROUP BY 1) USING (section_id) GROUP BY 1, 2)"""
NEXT = """nexts AS (SELECT unit_id, section_id,
  lead(section_id) OVER (PARTITION BY unit_id ORDER BY display_order) AS next_section_id FROM sections)"""
ITEMS = """items AS (SELECT section_id, 'lesson' AS kind, lesson_id AS item_id FROM lessons
  UNION ALL SELECT section_id, 'practice', practice_id FROM practices
  UNION ALL SELECT section_id, 'quiz', quiz_id FROM quizzes)"""
UNIT_TOTALS = """unit_totals AS (SELECT unit_id, count(*) AS total_lessons, sum(minutes)::BIGINT AS total_minutes
  FROM lessons JOIN sections USING (section_id) GROUP BY 1)"""

SQL = {
    "join_hierarchy": with_(LESSONS, SECTIONS, UNITS)
    + """SELECT lesson_id, section_id, unit_id, course_id, minutes FROM lessons JOIN sections USING (section_id)
JOIN cunits USING (unit_id)""",
    "resolve_parent_key": with_(PRACTICES, SECTIONS)
    + "SELECT practice_id, section_id, unit_id FROM practices JOIN sections USING (section_id)",
    "attach_progress": BASE
    + f"""SELECT user_id, section_id, item_id, title, display_order, minutes, {duration("minutes")} AS duration_label,
  status, {sidebar("status")} AS sidebar_status FROM lesson_rows""",
    "attach_practices": BASE
    + f"""SELECT *, {action("status")} AS action_label, {sidebar("status")} AS sidebar_status FROM practice_rows""",
    "attach_quizzes": BASE + f"SELECT *, {action('status')} AS action_label FROM quiz_rows",
    "flag_exists": with_(LESSONS, PROGRESS)
    + "SELECT lesson_id, lesson_id IN (SELECT lesson_id FROM progress) AS has_notes FROM lessons",
    "practice_totals": BASE + "SELECT * FROM totals",
    "score_attempt": with_(ATTEMPTS, PRACTICES)
    + """SELECT event_id, CASE WHEN required_correct > 0 THEN score >= required_correct ELSE score > 0 END AS passed,
  score * 50 >= 70 AS quiz_passed FROM attempts JOIN practices USING (practice_id)""",
    "progress_squares": BASE + "SELECT * FROM squares",
    "status_histogram": BASE
    + "SELECT user_id, "
    + ", ".join(
        f"count(*) FILTER (status = '{v}') AS n_{v}"
        for v in ("not_started", "attempted", "familiar", "practiced", "mastered", "locked")
    )
    + " FROM squares GROUP BY 1",
    "mastery_pct": BASE
    + """SELECT user_id, section_id, count(*) AS total, count(*) FILTER (status = 'mastered') AS completed,
  round_even((count(*) FILTER (status = 'mastered'))::DOUBLE / count(*) * 100, 2) AS mastered_pct FROM squares GROUP BY 1, 2""",
    "unit_totals": with_(LESSONS, SECTIONS, UNIT_TOTALS) + "SELECT * FROM unit_totals",
    "section_mastered": with_(LESSONS, DENSE, COMPLETE) + "SELECT * FROM complete",
    "next_section": with_(SECTIONS, NEXT) + "SELECT * FROM nexts",
    "unlock_wave": with_(SECTIONS, LESSONS, PRACTICES, QUIZZES, DENSE, COMPLETE, NEXT, ITEMS)
    + """SELECT c.user_id, i.section_id, i.kind, i.item_id, CASE WHEN i.kind <> 'quiz' THEN 'not_started' END AS status
FROM complete c JOIN nexts n ON n.section_id = c.section_id JOIN items i ON i.section_id = n.next_section_id
WHERE c.complete""",
    "initial_progress": with_(SECTIONS, LESSONS, PRACTICES, QUIZZES, ITEMS)
    + """SELECT s_suppkey AS user_id, unit_id, section_id, kind, item_id, CASE WHEN kind <> 'quiz' THEN
  CASE WHEN display_order = min(display_order) OVER (PARTITION BY unit_id) THEN 'not_started' ELSE 'locked' END END AS status
FROM supplier JOIN (SELECT unit_id, section_id, display_order FROM sections) ON unit_id = s_nationkey
JOIN items USING (section_id)""".replace(
        "min(display_order) OVER (PARTITION BY unit_id)",
        "(SELECT min(z.display_order) FROM sections z WHERE z.unit_id = s_nationkey)",
    ),
    "study_page": BASE
    + f""", {UNIT_TOTALS}, {CARDS}
SELECT user_id, unit_id, count(*) AS total, count(*) FILTER (status = 'mastered') AS completed,
  round_even((count(*) FILTER (status = 'mastered'))::DOUBLE / count(*) * 100, 2) AS mastered_pct,
  any_value(total_lessons) AS total_lessons, any_value(total_minutes) AS total_minutes,
  bool_or((user_id, unit_id) IN (SELECT (user_id, unit_id) FROM cards WHERE user_id IS NOT NULL AND NOT is_generated)) AS has_notes,
  bool_or((user_id, unit_id) IN (SELECT (user_id, unit_id) FROM cards WHERE user_id IS NOT NULL AND is_generated)) AS has_flashcards
FROM squares JOIN sections USING (section_id) JOIN unit_totals USING (unit_id) GROUP BY 1, 2""",
    "status_ladders": with_(PROGRESS)
    + """SELECT event_id, CASE status WHEN 'locked' THEN 'locked' WHEN 'mastered' THEN 'mastered'
    WHEN 'in_progress' THEN 'attempted' WHEN 'viewed' THEN 'familiar' ELSE 'not_started' END AS lesson,
  CASE WHEN status IN ('in_progress', 'mastered') THEN status ELSE 'not_started' END AS card,
  CASE WHEN score >= 70 THEN 'mastered' ELSE 'attempted' END AS quiz FROM progress""",
    "format_duration": with_(LESSONS) + f"SELECT lesson_id, {duration('(lesson_id % 400)')} AS label FROM lessons",
}
