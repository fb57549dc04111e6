from oracles import progress as P
from oracles.base import LATEST, LOGS, PROGRESS, with_

SQL = {
    "stream_registry": "SELECT DISTINCT regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS source, 'pending' AS status FROM pages",
    "stream_progress": with_(PROGRESS, LATEST) + "SELECT user_id, lesson_id, event_id, status, score FROM latest",
    "stream_attempts": P.SQL["practice_totals"],
    "expire_stale_requests": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS s FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
e AS (SELECT user_id AS target_id, max(ts) + INTERVAL 300 SECOND AS x, count(*) AS beats FROM k GROUP BY user_id, n)
SELECT target_id, strftime(x, '%Y-%m-%d %H:%M:%S.%f') AS expired_at, beats, 'failed' AS status FROM e
WHERE x <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_stage_log": with_(LOGS)
    + """SELECT strftime(created_at, '%Y-%m-%d') AS day, stage, count(*) AS n, count(*) FILTER (result = 'error') AS errors
FROM logs GROUP BY 1, 2""",
    "stream_unlock": P.SQL["unlock_wave"],
}
