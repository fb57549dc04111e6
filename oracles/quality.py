from oracles.base import COURSES, LESSONS, LOGS, RUNS, SECTIONS, UNITS, with_
from oracles.tables import CARDS

BASE = with_(COURSES, UNITS, SECTIONS, LESSONS, LOGS, RUNS)


def _counts(course, doc):
    c = lambda col: f"{col} = {course}" if course is not None else ("true" if doc is None else "false")
    d = lambda: f"doc_id = {doc}" if doc is not None else ("doc_id % 5 = 2" if course is not None else "true")
    return f"""SELECT * FROM (
SELECT 'courses' AS table_name, count(*) AS row_count FROM courses WHERE {c("course_id")}
UNION ALL SELECT 'units', count(*) FROM cunits WHERE {c("course_id")}
UNION ALL SELECT 'sections', count(*) FROM sections JOIN cunits USING (unit_id) WHERE {c("course_id")}
UNION ALL SELECT 'lessons', count(*) FROM lessons JOIN sections USING (section_id) JOIN cunits USING (unit_id) WHERE {c("course_id")}
UNION ALL SELECT 'documents', count(*) FROM documents WHERE {d()}
UNION ALL SELECT 'course_documents', count(*) FROM documents WHERE {d()}
UNION ALL SELECT 'lp_document_process', count(*) FROM runs WHERE {d() if course is None else "doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 2)"})"""


COLS = """stats AS (SELECT 'cards' AS table_name, 'user_id' AS column_name, count(*) FILTER (user_id IS NULL) AS null_count,
    0::BIGINT AS empty_string_count FROM cards
  UNION ALL SELECT 'cards', 'course_id', count(*) FILTER (course_id IS NULL), 0 FROM cards
  UNION ALL SELECT 'cards', 'text', count(*) FILTER (text IS NULL), count(*) FILTER (text = '')
    FROM cards LEFT JOIN documents ON doc_id = card_id
  UNION ALL SELECT 'documents', 'source', count(*) FILTER (source IS NULL), count(*) FILTER (source = '') FROM documents
  UNION ALL SELECT 'documents', 'lang', count(*) FILTER (lang IS NULL), count(*) FILTER (lang = '') FROM documents
  UNION ALL SELECT 'documents', 'text', count(*) FILTER (text IS NULL), count(*) FILTER (text = '') FROM documents)"""
ORPHANS = "lost AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
RATIO = """ratio AS (
  SELECT 'ratio.lessons.to.sections' AS rule_id, (SELECT count(*) FROM sections) AS a, (SELECT count(*) FROM lessons) AS b,
    'sections' AS driving, 'lessons' AS dependent
  UNION ALL SELECT 'ratio.lessons.to.documents', (SELECT count(*) FROM lessons), (SELECT count(*) FROM documents),
    'lessons', 'documents')"""
RATIO_ROWS = """SELECT rule_id, 'warning' AS severity, dependent AS table_name,
  printf('Cross-table ratio %.3f below minimum %.3f for %s/%s', b / a, 1.0::DOUBLE, dependent, driving) AS message,
  greatest(0, a - b)::BIGINT AS affected_count FROM ratio WHERE b < a
UNION ALL SELECT 'ratio.lp_book_page.to.lp_book_lesson', 'warning', 'lp_book_lesson',
  'Cross-table ratio check missing table ''lp_book_lesson''', 1::BIGINT"""
FINDINGS = f"""findings AS (SELECT 'table.lp_documents.non_empty' AS rule_id, 'warning' AS severity, 'lp_documents' AS table_name,
  'Table ''lp_documents'' has zero rows' AS message, 1::BIGINT AS affected_count
UNION ALL SELECT 'table.lp_book_item.non_empty', 'warning', 'lp_book_item', 'Table ''lp_book_item'' is missing from report', 1
UNION ALL SELECT 'columns.cards.required', 'warning', 'cards', 'Required columns have missing/invalid values: '
  || (SELECT string_agg(column_name, ', ' ORDER BY p) FROM (SELECT column_name, CASE column_name WHEN 'user_id' THEN 0 ELSE 1 END AS p
      FROM stats WHERE table_name = 'cards' AND column_name <> 'course_id' AND null_count + empty_string_count > 0
      UNION ALL SELECT 'absent', 2)),
  (SELECT (sum(null_count + empty_string_count) + 1)::BIGINT FROM stats WHERE table_name = 'cards' AND column_name <> 'course_id')
UNION ALL SELECT 'columns.documents.required', 'error', 'documents', 'Required columns have missing/invalid values: '
  || string_agg(column_name, ', ' ORDER BY column_name DESC), sum(null_count + empty_string_count)::BIGINT FROM stats
  WHERE table_name = 'documents' AND column_name <> 'text' AND null_count + empty_string_count > 0 HAVING count(*) > 0
UNION ALL SELECT 'fk.documents.labels', 'error', 'documents',
  'Foreign-key orphans detected in relation ''documents.doc_id->labels.doc_id''', count(*) FROM lost HAVING count(*) > 0
UNION ALL {RATIO_ROWS})"""
SQL = {
    "scope_filter": BASE + _counts(2, None),
    "scope_filter_document": BASE + _counts(2, None).replace("doc_id % 5 = 2", "doc_id = 7"),
    "table_row_counts": BASE + _counts(None, None),
    "required_column_stats": with_(CARDS, COLS) + "SELECT * FROM stats",
    "find_orphans": with_(ORPHANS)
    + """SELECT 'documents.doc_id->labels.doc_id' AS relation_name, count(*) AS orphan_count,
  (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM lost ORDER BY doc_id LIMIT 5)) AS samples FROM lost""",
    "expected_non_empty": """SELECT 'lp_documents' AS table_name, 'warning' AS severity,
  'lp_documents should contain canonical representation for scoped document' AS reason,
  (SELECT count(*) FROM documents WHERE doc_id < 0) AS row_count""",
    "cross_table_ratio": with_(SECTIONS, LESSONS, RATIO) + RATIO_ROWS,
    "evaluate_dq_rules": with_(SECTIONS, LESSONS, CARDS, COLS, ORPHANS, RATIO, FINDINGS) + "SELECT * FROM findings",
    "verdict": with_(SECTIONS, LESSONS, CARDS, COLS, ORPHANS, RATIO, FINDINGS)
    + """SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (severity = 'warning') > 0
  THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS finding_count, count(*) FILTER (severity = 'error') AS error_count,
  count(*) FILTER (severity = 'warning') AS warning_count FROM findings""",
}
