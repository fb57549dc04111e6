from oracles.base import LOGS, RUNS, with_

MODED = """moded AS (SELECT run_id, doc_id, last_completed_stage, CASE WHEN run_id % 2 = 0 THEN failed_stage END AS failed_stage,
  CASE WHEN run_id % 9 = 0 THEN 'reprocess' WHEN retry_count > 0 THEN 'retry' ELSE 'process' END AS run_mode FROM runs)"""


def _bucket(v):
    return f"""CASE WHEN {v} IN ('page_grouping', 'enricher', 'unit_builder', 'concept_extractor') THEN 'page_grouping'
  WHEN {v} = 'graph_builder' THEN 'graph_builder' WHEN {v} IN ('sequence_builder', 'pipeline') THEN 'sequence_builder'
  ELSE 'parser' END"""


WANTED = f"""wanted AS (SELECT doc_id, run_id, CASE WHEN run_mode <> 'retry' THEN 'parser'
  WHEN failed_stage IS NOT NULL THEN {_bucket("failed_stage")}
  ELSE CASE WHEN last_completed_stage IN ('normalizer', 'page_grouping', 'enricher', 'unit_builder') THEN 'page_grouping'
    WHEN last_completed_stage = 'concept_extractor' THEN 'graph_builder'
    WHEN last_completed_stage IN ('graph_builder', 'sequence_builder', 'pipeline') THEN 'sequence_builder'
    ELSE 'parser' END END AS wanted FROM moded)"""
SQL = {
    "resume_stage": with_(LOGS, RUNS, MODED, WANTED) + "SELECT run_id, wanted AS stage FROM wanted",
    "pending_work": with_(LOGS, RUNS, MODED, WANTED)
    + """, saved AS (SELECT run_id // 3 * 7 % (SELECT count(*) FROM documents) AS doc_id, list(DISTINCT stage) AS done FROM logs WHERE result = 'success' GROUP BY 1)
SELECT doc_id, run_id, wanted, CASE
  WHEN wanted = 'page_grouping' AND list_contains(done, 'normalizer') THEN wanted
  WHEN wanted = 'graph_builder' AND list_has_all(done, ['normalizer', 'unit_builder', 'concept_extractor']) THEN wanted
  WHEN wanted = 'sequence_builder'
    AND list_has_all(done, ['normalizer', 'unit_builder', 'concept_extractor', 'graph_builder']) THEN wanted
  ELSE 'parser' END AS stage FROM wanted LEFT JOIN saved USING (doc_id)""",
    "superseded_runs": with_(LOGS, RUNS)
    + """SELECT run_id, doc_id, CASE WHEN status = 'pending' AND run_id < max(run_id) OVER (PARTITION BY doc_id)
  THEN 'cancelled' ELSE status END AS status FROM runs""",
    "runs_with_stages": with_(LOGS, RUNS)
    + """SELECT run_id, status, coalesce(n, 1) AS n_stages, coalesce(stages, 'pipeline:' || status) AS stages
FROM runs LEFT JOIN (SELECT run_id, count(*)::INTEGER AS n,
  string_agg(stage || ':' || result, '>' ORDER BY created_at, log_id) AS stages FROM logs
  GROUP BY 1) USING (run_id)""",
    "stage_log_summary": with_(LOGS)
    + """SELECT run_id // 3 * 7 % (SELECT count(*) FROM documents) AS doc_id, stage, result, count(*) AS n,
  strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM logs GROUP BY 1, 2, 3""",
    "advance_run_state": with_(LOGS, RUNS)
    + """, o AS (SELECT *, (['pipeline_ok', 'book_ok', 'error', 'restart'])[run_id // 3 % 4 + 1] AS outcome FROM runs)
SELECT run_id, CASE
    WHEN status = 'pending' AND outcome = 'pipeline_ok' THEN 'processing'
    WHEN status = 'processing' AND outcome = 'book_ok' AND last_completed_stage = 'pipeline' THEN 'completed'
    WHEN status = 'pending' AND outcome = 'error' AND retry_count + 1 >= max_retries THEN 'failed'
    WHEN status = 'processing' AND outcome = 'restart' AND last_completed_stage IS DISTINCT FROM 'pipeline' THEN 'pending'
    ELSE status END AS status,
  CASE WHEN (status = 'pending' AND outcome = 'error' AND retry_count + 1 < max_retries)
    OR (status = 'processing' AND outcome = 'restart' AND last_completed_stage IS DISTINCT FROM 'pipeline')
    THEN 'retry' ELSE 'process' END AS run_mode,
  retry_count + CASE WHEN status = 'pending' AND outcome = 'error' AND retry_count + 1 < max_retries THEN 1 ELSE 0 END
    AS retry_count,
  CASE WHEN status = 'pending' AND outcome = 'pipeline_ok' THEN 'pipeline' ELSE last_completed_stage END
    AS last_completed_stage FROM o""",
    "missing_agents": """
WITH done AS (SELECT DISTINCT l_orderkey AS lesson_id,
  (['keywords', 'summaries', 'flashcards', 'quizzes', 'practice'])[l_linenumber % 5 + 1] AS kind FROM lineitem),
need AS (SELECT lesson_id, k FROM (SELECT DISTINCT lesson_id FROM done),
  (SELECT unnest(['flashcards', 'keywords', 'practice', 'quizzes', 'summaries']) AS k))
SELECT n.lesson_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (kind IS NULL), '') AS missing,
  CASE WHEN count(*) FILTER (kind IS NULL) = 0 THEN 'completed' ELSE 'failed' END AS status
FROM need n LEFT JOIN done d ON d.lesson_id = n.lesson_id AND d.kind = n.k GROUP BY 1""",
    "combined_status": with_(LOGS, RUNS)
    + """, p AS (SELECT run_id, status AS proc, CASE run_id % 5 WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'completed'
  END AS book FROM runs),
c AS (SELECT *, CASE WHEN book = 'failed' THEN 'failed' WHEN book = 'pending' THEN 'processing' ELSE proc END AS combined FROM p)
SELECT run_id, combined, CASE
  WHEN proc = 'completed' AND book = 'pending' THEN 'Primary pipeline completed; book pipeline is still running'
  WHEN book = 'failed' THEN 'Book pipeline failed; call /process/retry to retry'
  WHEN combined = 'completed' THEN 'Document processing already completed'
  WHEN combined = 'failed' THEN 'Document processing failed; call /process/retry to retry'
  ELSE 'Document processing already started' END AS message FROM c""",
}
