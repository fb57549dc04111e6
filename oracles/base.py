"""Common table expressions shared by the SQL of several areas."""

from __future__ import annotations


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


COURSES = "courses AS (SELECT r_regionkey::BIGINT AS course_id, r_name AS title FROM region)"
UNITS = """cunits AS (SELECT n_nationkey::BIGINT AS unit_id, n_regionkey::BIGINT AS course_id, n_name AS title
  FROM nation)"""
SECTIONS = """sections AS (SELECT c_custkey AS section_id, c_nationkey::BIGINT AS unit_id, c_name AS title,
  c_custkey AS display_order, c_mktsegment AS segment FROM customer)"""
LESSONS = """lessons AS (SELECT o_orderkey AS lesson_id, o_custkey AS section_id, o_orderpriority AS title,
  (o_orderkey % 90)::INTEGER AS minutes, o_orderkey AS display_order, o_orderdate AS created_at,
  o_orderstatus AS kind FROM orders)"""
PRACTICES = """practices AS (SELECT p_partkey AS practice_id, p_partkey * 3 // 4 AS section_id, p_name AS title,
  (p_size % 10)::INTEGER AS required_correct, 10 AS total_questions, p_partkey AS display_order FROM part)"""
QUIZZES = "quizzes AS (SELECT s_suppkey AS quiz_id, s_suppkey * 15 AS section_id, s_name AS title FROM supplier)"
PROGRESS = """progress AS (SELECT event_id, ts, user_id, (user_id * 100 + event_id * 7 % 100) % (SELECT count(*) FROM orders) AS lesson_id,
  CASE event_type WHEN 'view' THEN 'viewed' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'mastered'
    WHEN 'error' THEN 'locked' ELSE 'not_started' END AS status,
  CASE WHEN event_type = 'purchase' THEN ts END AS completed_at, value / 5 AS score FROM events)"""
LATEST = """latest AS (SELECT * FROM progress
  QUALIFY row_number() OVER (PARTITION BY user_id, lesson_id ORDER BY event_id DESC) = 1)"""
DENSE = """dense AS (SELECT k AS user_id, o_orderkey AS lesson_id, o_custkey AS section_id,
  CASE WHEN (o_custkey + k) % 3 = 0 OR o_orderkey % 4 = 0 THEN 'mastered' ELSE 'in_progress' END AS status
  FROM orders, (SELECT unnest([0, 1, 2])::BIGINT AS k))"""
ATTEMPTS = """attempts AS (SELECT event_id, ts, user_id, (user_id * 13 + event_id * 11 % 14) % (SELECT count(*) FROM part) AS practice_id, value / 50 AS score
  FROM events WHERE event_type IN ('purchase', 'click'))"""
QUIZ_RESULTS = """quiz_results AS (SELECT user_id, (user_id + event_id % 3) % (SELECT count(*) FROM supplier) AS quiz_id, arg_max(value, event_id) AS score,
  max(ts) AS completed_at FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2)"""
LOGS = """logs AS (SELECT event_id AS log_id, event_id // 5 AS run_id,
  (['parser', 'normalizer', 'page_grouping', 'enricher', 'unit_builder', 'concept_extractor', 'graph_builder',
    'sequence_builder', 'pipeline'])[event_id % 5 + 1] AS stage,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS result, value AS duration, ts AS created_at
  FROM events)"""
RUNS = """runs AS (SELECT run_id, run_id // 3 * 7 % (SELECT count(*) FROM documents) AS doc_id,
  CASE count(*) FILTER (result = 'error') WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing'
    ELSE 'failed' END AS status,
  (count(*) FILTER (result = 'error'))::INTEGER AS retry_count, 3 AS max_retries,
  arg_max(stage, log_id) FILTER (result <> 'error') AS last_completed_stage,
  arg_max(stage, log_id) FILTER (result = 'error') AS failed_stage,
  min(created_at) AS created_at, max(created_at) AS updated_at FROM logs GROUP BY run_id)"""
ROLE_OF = "role_of AS (SELECT c_custkey AS user_id, c_mktsegment AS role FROM customer)"
ROLE_PERM = """role_perm AS (SELECT DISTINCT c_mktsegment AS role, o_orderpriority AS permission
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LINES = """lines AS (SELECT doc_id, (i - 1)::INTEGER AS n, parts[i] AS line,
    length(line)::INTEGER AS len, CASE WHEN i > 1 THEN length(parts[i - 1]) END AS prev_len
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"""


def _type(n: str, size: str) -> str:
    return f"""CASE WHEN {n} = 0 OR {size} < 40 THEN 'heading' WHEN {n} % 11 = 5 THEN 'figure'
    WHEN {n} % 13 = 7 THEN 'equation' WHEN {n} % 7 = 3 THEN 'list' WHEN {n} % 17 = 8 THEN 'question'
    WHEN {n} % 19 = 6 THEN 'page_header' WHEN {n} % 23 = 9 THEN 'code' ELSE 'paragraph' END"""


NODES = (
    LINES
    + f""",
typed AS (SELECT *, {_type("n", "len")} AS node_type, {_type("(n - 1)", "prev_len")} AS prev_type FROM lines),
nodes AS (SELECT doc_id, doc_id || '/' || n AS node_id, n AS seq, n // 8 + 1 AS page, node_type,
  CASE WHEN n = 0 THEN 1 WHEN len < 40 THEN 2 + n % 3 ELSE 0 END AS level,
  CASE WHEN node_type = 'paragraph' AND n > 0 AND prev_type = 'figure' THEN 'Figure ' || n || ' '
    WHEN node_type = 'heading' AND (doc_id + n) % 19 = 9 THEN 'Chapter ' || n || '. '
    WHEN node_type = 'heading' AND (doc_id + n) % 19 = 10 THEN 'Section ' || n || ': '
    ELSE CASE (doc_id + n) % 19 WHEN 0 THEN 'Definition: ' WHEN 1 THEN 'Example: ' WHEN 2 THEN 'Note: '
      WHEN 3 THEN 'See Figure ' || n || '. ' WHEN 4 THEN 'Summary: ' WHEN 5 THEN 'Step 1: ' WHEN 6 THEN 'Rule: '
      WHEN 7 THEN 'Objective: ' WHEN 8 THEN 'Exercise ' || n || ': ' ELSE '' END END || line AS text,
  CASE WHEN n % 2 = 0 THEN 'bullet' ELSE 'numbered' END AS list_style, n % 5 = 0 AS boundary_preserved,
  (n * 37 % 100) / 100.0::DOUBLE AS x, (n % 8) / 8.0::DOUBLE AS y, 0.10::DOUBLE + (n * 13 % 40) / 100.0::DOUBLE AS w,
  0.10::DOUBLE AS h FROM typed)"""
)
WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '^{WS}+', ''), '{WS}+$', '')"


def collapse(v: str) -> str:
    return f"trim(regexp_replace({v}, '{WS}+', ' ', 'g'))"


def fold(v: str) -> str:
    return f"lower({collapse(v)})"


def words(v: str) -> str:
    return f"len(list_filter(regexp_split_to_array({v}, '{WS}+'), lambda t: t <> ''))::INTEGER"


def shorten(v: str, width: int) -> str:
    c = collapse(v)
    return (
        f"CASE WHEN length({c}) <= {width} THEN {c} "
        f"ELSE rtrim(regexp_extract({c}, '^(.{{1,{width - 1}}}) ', 1)) || '…' END"
    )
