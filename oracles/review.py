from oracles.annotations import ctes
from oracles.base import NODES, WS, strip, with_
from oracles.concepts import PAGES, mentions

PAIRS = """pairs AS (SELECT doc_id, page, page_text AS a, CASE WHEN page % 5 = 4 THEN NULL WHEN doc_id % 3 = 0
  THEN regexp_replace(page_text, ' (?:le|the|der|el) ', ' ', 'g') ELSE page_text END AS g FROM pages_t)"""
PROFILE = "prof AS (SELECT doc_id, node_type, count(*) AS n FROM nodes GROUP BY 1, 2)"


def toks(v):
    return f"list_filter(regexp_split_to_array(lower({v}), '{WS}+'), lambda t: t <> '')"


W = "[^\\p{L}\\p{N}_]"


def first(text, term):
    """Place of the first whole word: a blank before the text stands for its start."""
    return f"nullif(length(regexp_extract(' ' || lower({text}) || ' ', '(?s)^(.*?{W}){term}{W}', 1)), 0)"


SQL = {
    "join_rendered_pages": with_(NODES, PAGES, PAIRS)
    + "SELECT doc_id, page, CASE WHEN g IS NULL THEN 'canonical_missing' ELSE 'reviewed' END AS review_status FROM pairs",
    "missing_tokens": with_(NODES, PAGES, PAIRS)
    + f""", t AS (SELECT doc_id, page, unnest(ta) AS k, unnest(range(0, len(ta))) AS i FROM (SELECT doc_id, page, {toks("a")} AS ta
  FROM pairs WHERE g IS NOT NULL)),
h AS (SELECT DISTINCT doc_id, page, unnest({toks("g")}) AS k FROM pairs WHERE g IS NOT NULL),
u AS (SELECT doc_id, page, k, min(i) AS i FROM t ANTI JOIN h USING (doc_id, page, k) GROUP BY 1, 2, 3)
SELECT p.doc_id, p.page, count(k)::INTEGER AS n, coalesce(string_agg(k, ' ' ORDER BY i), '') AS tokens
FROM pairs p LEFT JOIN u USING (doc_id, page) WHERE g IS NOT NULL GROUP BY 1, 2""",
    "page_counts": with_(NODES, PAGES, PAIRS)
    + f"""SELECT doc_id, page, length(a)::INTEGER AS text_char_count_actual, len({toks("a")})::INTEGER AS token_count_actual,
  length(g)::INTEGER AS text_char_count_generated, len({toks("g")})::INTEGER AS token_count_generated FROM pairs WHERE g IS NOT NULL""",
    "review_verdict": with_(NODES, PAGES, PAIRS)
    + """, v AS (SELECT doc_id, g IS NOT NULL AS ok, CASE WHEN g IS NULL THEN NULL WHEN length(a) % 7 = 0 THEN 'rejected'
  WHEN length(a) % 7 < 3 THEN 'needs_revision' ELSE 'approved' END AS verdict FROM pairs)
SELECT doc_id, CASE WHEN count(*) FILTER (ok) = 0 THEN 'needs_revision' WHEN bool_or(verdict = 'rejected') THEN 'rejected'
  WHEN bool_or(verdict = 'needs_revision') THEN 'needs_revision' ELSE 'approved' END AS verdict,
  printf('Reviewed %d page(s): %d reviewed, %d skipped/errors; %d approved, %d needs_revision, %d rejected.', count(*),
    count(*) FILTER (ok), count(*) FILTER (NOT ok), count(*) FILTER (verdict = 'approved'),
    count(*) FILTER (verdict = 'needs_revision'), count(*) FILTER (verdict = 'rejected')) AS summary FROM v GROUP BY 1""",
    "search_text": f"""WITH s AS (SELECT doc_id, {mentions("text", "'the'")} + {mentions("text", "'and'")} AS score,
  least({first("text", "the")}, {first("text", "and")})::INTEGER AS first_hit FROM documents WHERE lang = 'en')
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5""",
    "search_index": f"""WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN 'The end. ' || upper(text) ELSE text END AS text
  FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0),
s AS (SELECT doc_id, text, {mentions("text", "'the'")} + {mentions("text", "'and'")} AS score,
  least({first("text", "the")}, {first("text", "and")})::INTEGER AS first_hit FROM d WHERE lang IN ('en', 'de') AND source <> 'src3'),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30 OFFSET 3)
SELECT doc_id, score, first_hit, substring(text, greatest(1, first_hit - 20), 80) AS snippet,
  array_to_string(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) IN ('the', 'and'))[1:5], ' ') AS highlights FROM t""",
    "similarity_topk": """WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS d FROM embeddings),
c AS (SELECT label, d, avg(v) AS m FROM f GROUP BY 1, 2),
s AS (SELECT c.label, f.vec_id, sum(f.v * c.m) / (sqrt(sum(f.v * f.v)) * sqrt(sum(c.m * c.m))) AS score
  FROM f JOIN c USING (d) GROUP BY 1, 2)
SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id))::INTEGER AS rank, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5""",
    "flashcard_seeds": with_(NODES, ctes("nodes"))
    + f""", d AS (SELECT * FROM a_def UNION ALL SELECT * FROM a_inl),
b AS (SELECT term AS front, body AS bk, 'definition' AS source FROM d UNION ALL
  SELECT CASE WHEN seq % 2 = 0 THEN 'Eq ' || node_id ELSE 'Equation' END, {strip("text")}, 'equation' FROM nodes WHERE node_type = 'equation')
SELECT front, bk AS "back", min(source) AS source FROM b WHERE front <> '' AND bk <> '' GROUP BY 1, 2""",
    "quiz_points": "SELECT l_suppkey AS quiz_id, sum(l_quantity) AS total_points, count(*) AS n_questions FROM lineitem GROUP BY 1",
    "read_artifacts": with_(NODES, PROFILE) + "SELECT * FROM prof WHERE doc_id IN (SELECT doc_id FROM labels)",
    "replace_by_document": with_(NODES, PROFILE)
    + """SELECT * FROM prof WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'label', quality + 10 FROM labels""",
    "write_json_export": with_(NODES, PROFILE) + "SELECT * FROM prof",
}
