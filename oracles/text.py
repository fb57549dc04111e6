from oracles.base import LINES, NODES, collapse, fold, shorten, strip, with_, words

NUM = """num AS (SELECT doc_id, n AS seq, CASE n % 9 WHEN 0 THEN '[x] ' WHEN 1 THEN '[ ] ' WHEN 2 THEN n || '. ' WHEN 3 THEN 'iv) '
  WHEN 4 THEN 'B. ' WHEN 5 THEN '1.' || n || ' ' WHEN 6 THEN 'Appendix C ' WHEN 7 THEN '☐ ' ELSE '' END || line AS text FROM lines)"""
BLANKS = f"""raw AS (SELECT doc_id, n AS seq, CASE n % 3 WHEN 0 THEN n || ') ' || line || ' (1) ___ and (12)....'
  WHEN 1 THEN line || ' (7) __' ELSE line END AS t0 FROM lines),
blanks AS (SELECT doc_id, seq, {strip("t0")} AS t FROM raw)"""
_BLANK = "\\((\\d+)\\)\\s*(_{2,}|\\.+|$)"
_UUID = "left({0}, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
_H = r"^((?:\d+\.)*\d+|[A-Z]\.|Appendix\s+[A-Z])\s+(.*)$"
REPLY = """src AS (SELECT conv_id || '/' || turn AS reply_id, (conv_id + turn) % 4 AS kind, role, turn,
    regexp_replace(text, '["\\\\\\x00-\\x1f{}`]', ' ', 'g') AS t FROM conversations),
good AS (SELECT * FROM src WHERE kind <> 3)"""
K = ("(l_orderkey % 600)::DOUBLE", "(l_partkey % 800)::DOUBLE", "(l_suppkey * 7 % 600)::DOUBLE", "(l_orderkey * 3 % 800)::DOUBLE")

SQL = {
    "fold_text": with_(LINES) + f"SELECT doc_id, n AS seq, {fold('line')} AS folded FROM lines",
    "word_count": with_(LINES) + f"SELECT doc_id, n AS seq, {words('line')} AS words FROM lines",
    "shorten": with_(LINES) + f"SELECT doc_id, n AS seq, {shorten('line', 120)} AS short FROM lines",
    "summary_word_count": f"SELECT doc_id, {words('text')} AS words FROM documents",
    "classify_heading": with_(NODES)
    + f""", h AS (SELECT node_id, level, CASE seq % 4 WHEN 1 THEN 'chapter' WHEN 2 THEN 'lab' ELSE
  rtrim(lower(split_part({collapse("text")}, ' ', 1)), '.:') END AS word FROM nodes WHERE node_type = 'heading')
SELECT node_id, CASE WHEN word IN ('chapter', 'unit', 'module', 'part') THEN 'chapter'
  WHEN word IN ('lesson', 'section', 'topic', 'lab') THEN 'lesson' WHEN level <= 1 THEN 'chapter'
  WHEN level <= 2 THEN 'lesson' ELSE 'topic' END AS kind FROM h""",
    "split_heading_number": with_(LINES, NUM)
    + f"""SELECT doc_id, seq, regexp_extract(text, '{_H}', 1) AS number,
  CASE WHEN regexp_matches(text, '{_H}') THEN regexp_extract(text, '{_H}', 2) ELSE text END AS title FROM num""",
    "infer_list_style": with_(LINES, NUM)
    + r"""SELECT doc_id, seq, CASE WHEN seq % 11 = 0 OR regexp_matches(text, '^\s*(\[[xX ]\]|☐|☑|✓)\s+') THEN 'checkbox'
  WHEN regexp_matches(text, '^\s*\d+[.)]\s+') THEN 'numbered'
  WHEN regexp_matches(text, '^\s*[IVXLCDMivxlcdm][IVXLCDMivxlcdm]+[.)]\s+') THEN 'roman'
  WHEN regexp_matches(text, '^\s*[A-Za-z][.)]\s+') THEN 'alpha' ELSE 'bullet' END AS style,
  CASE WHEN regexp_matches(text, '^\s*(\[[xX]\]|☑|✓)\s+') THEN true
  WHEN regexp_matches(text, '^\s*(\[\s*\]|☐)\s+') THEN false END AS checked FROM num""",
    "text_hints": with_(LINES, BLANKS)
    + f""", m AS (SELECT doc_id, seq, t, regexp_extract_all(t, '{_BLANK}', 1) AS ids,
  string_split_regex(t, '{_BLANK}') AS gaps, regexp_extract_all(t, '{_BLANK}') AS hits FROM blanks)
SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN 'selected' WHEN 1 THEN 'unselected' END AS state,
  try_cast(nullif(regexp_extract(t, '^\\s*(\\d+)[.)]\\s+', 1), '') AS INTEGER) AS numbered_item,
  array_to_string(ids, ',') AS blank_ids,
  CASE WHEN len(ids) >= 2 THEN array_to_string([len(array_to_string(gaps[1:i], '')) + len(array_to_string(hits[1:i - 1], ''))
    for i in range(1, len(ids) + 1)], ',') ELSE '' END AS blank_positions FROM m""",
    "url_to_slug": """WITH r AS (SELECT page_id, trim(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '[^a-zA-Z0-9]+', '_', 'g'), '_') AS g
  FROM pages)
SELECT page_id, CASE WHEN g = '' THEN 'document.pdf' WHEN length(g) > 100 THEN rtrim(left(g, 100), '_') || '.pdf' ELSE g || '.pdf' END AS slug
FROM r""",
    "safe_filename": r"""WITH b AS (SELECT page_id, page_id % 7 AS a, page_id % 5 + page_id % 7 AS z,
  regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS safe FROM pages)
SELECT page_id, CASE WHEN safe = '' THEN 'unnamed' ELSE safe END AS safe,
  CASE WHEN page_id % 2 = 0 THEN CASE WHEN safe = '' THEN '.docx' ELSE safe END || '.pdf'
    ELSE CASE WHEN safe = '' THEN '.pdf' ELSE safe END || '.sample-p' || a || CASE WHEN a <> z THEN '-' || z ELSE '' END || '.pdf' END
    AS sample FROM b""",
    "stable_doc_id": f"""WITH d AS (SELECT page_id, sha256(url) AS digest FROM pages)
SELECT page_id, digest, {_UUID.format("digest")} AS uuid,
  CASE WHEN page_id % 3 > 0 THEN {_UUID.format("digest")} END AS parsed FROM d""",
    "canonical_ref": """WITH r AS (SELECT page_id, CASE WHEN page_id % 5 <= 2 THEN '#' || regexp_replace(url, '^https?:/', '') ELSE '#/body' END AS ref
  FROM pages), p AS (SELECT *, list_filter(string_split(substr(ref, 3), '/'), lambda x: x <> '') AS parts FROM r)
SELECT page_id, ref, CASE WHEN len(parts) > 1 THEN '#/' || array_to_string(parts[1:len(parts) - 1], '/') ELSE '#/body' END AS parent FROM p""",
    "scan_binary_inventory": """SELECT left(sha256(url), 12) AS doc_id, 'doc' || page_id || '.pdf' AS filename, strlen(html) AS length, true AS recent,
  left(sha256(url), 12) || '__name=doc' || page_id || '__sha=abc' || CASE WHEN page_id % 3 = 0 THEN '__mode=path' ELSE '__junk' END || '.pdf' AS stored_as,
  CASE WHEN page_id % 4 = 1 THEN '' ELSE 'abc' END AS sha256, CASE WHEN page_id % 3 = 0 THEN 'path' ELSE 'base64' END AS source_mode
FROM pages WHERE page_id % 7 <> 0 AND page_id % 4 <> 1 AND page_id % 3 <> 1""",
    "validate_questions": with_(REPLY)
    + """SELECT reply_id, 0 AS pos, trim('Why ' || t) AS question, 'a|b|' || role AS choices,
  CASE WHEN turn - 1 BETWEEN 0 AND 2 THEN (turn - 1)::INTEGER ELSE 0 END AS correct_index FROM good""",
    "extract_key_terms": with_(REPLY)
    + "SELECT reply_id, role AS term, trim(t) AS definition FROM good WHERE trim(t) <> ''",
    "key_term_cards": with_(REPLY)
    + 'SELECT reply_id, role AS front, trim(t) AS "back" FROM good WHERE trim(t) <> \'\'',
    "normalise_bbox": f"""
WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least({K[0]}, {K[2]}) AS x0, greatest({K[0]}, {K[2]}) AS x1,
  CASE WHEN l_linenumber % 2 = 0 THEN 800 - greatest({K[1]}, {K[3]}) ELSE least({K[1]}, {K[3]}) END AS y0,
  CASE WHEN l_linenumber % 2 = 0 THEN 800 - least({K[1]}, {K[3]}) ELSE greatest({K[1]}, {K[3]}) END AS y1 FROM lineitem),
n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN y0 > 1 THEN y0 / 800 ELSE y0 END AS top,
  CASE WHEN x0 > 1 THEN x0 / 600 ELSE x0 END AS "left", CASE WHEN y1 > 1 THEN y1 / 800 ELSE y1 END AS bottom,
  CASE WHEN x1 > 1 THEN x1 / 600 ELSE x1 END AS "right" FROM b)
SELECT *, round(CASE WHEN ("right" - "left") * (bottom - top) = 0 THEN 0.0::DOUBLE
  ELSE greatest(0, least("right", 0.75) - greatest("left", 0.25)) * greatest(0, least(bottom, 0.75) - greatest(top, 0.25))
    / (("right" - "left") * (bottom - top)) END, 9) + 0.0::DOUBLE AS ratio FROM n""",
}
