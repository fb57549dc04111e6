from oracles.annotations import ANNOTATED
from oracles.base import WS, strip, with_
from oracles.structure import FIXED
from oracles.units import MEMBERS

_E = r"(?:\.|;|\n|$)"
PATS = [
    ("skill", 0, r"(?i)(?:learning\s+objective|you\s+will|students?\s+will|by\s+the\s+end|able\s+to)\s*[:\-]?\s*(.+?)" + _E),
    ("skill", 1, r"(?i)(?:skill|competency|ability\s+to)\s*[:\-]\s*(.+?)" + _E),
    ("process", 2, r"(?i)(?:step\s+\d+|first|second|third|then|next|finally)\s*[:\-–—]\s*(.+?)" + _E),
    ("process", 3, r"(?i)(?:process|procedure|method|algorithm)\s+(?:of|for|to)\s+(.+?)" + _E),
    ("fact", 4, r"(?i)(?:fact|key\s+point|important|note\s+that)\s*[:\-–—]\s*(.+?)" + _E),
    ("fact", 5, r"(?i)(.+?)\s+is\s+(?:always|never|defined\s+as)\s+.+?" + _E),
    ("rule", 6, r"(?i)(?:rule|law|principle|theorem|axiom)\s*[:\-–—]\s*(.+?)" + _E),
    ("rule", 7, r"(?i)(?:must|shall|always|required\s+to)\s+(.+?)" + _E),
    ("formula", 8, r"(?i)(?:formula|equation|expression)\s*[:\-–—]\s*(.+?)" + _E),
    ("formula", 9, r"(?i)([A-Za-z]\s*=\s*[A-Za-z0-9\s\+\-\*/\^\(\)]+)"),
]
DEDUPED = """deduped AS (SELECT * FROM anns
  QUALIFY row_number() OVER (PARTITION BY type, node_id ORDER BY confidence DESC, emit, ord) = 1)"""
FROM_ANN = f"""from_ann AS (SELECT * FROM (SELECT doc_id,
  CASE WHEN type = 'objective' THEN {strip("body")} ELSE {strip("term")} END AS name,
  CASE type WHEN 'definition' THEN 'definition' WHEN 'key_term' THEN 'vocab' ELSE 'skill' END AS category,
  confidence * CASE WHEN type = 'objective' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS importance, 1::BIGINT AS mentions, node_id,
  [0, emit, CASE WHEN type = 'key_term' THEN 0 ELSE ord // 1000000 END, seq, ord] AS o
  FROM deduped WHERE type IN ('definition', 'key_term', 'objective')) WHERE name <> '')"""
PAGES = """pages_t AS (SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY seq)
  FILTER (text <> '' AND node_type <> 'page_header'), '') AS page_text FROM nodes GROUP BY 1, 2)"""


def mentions(text, term):
    """Whole words only; every separator is doubled so that neighbours do not share one."""
    double = "regexp_replace({0}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    return f"""len(regexp_extract_all({double.format(f"' ' || lower({text}) || ' '")},
  '[^\\p{{L}}\\p{{N}}_]\\Q' || {double.format(f"lower({term})")} || '\\E[^\\p{{L}}\\p{{N}}_]'))::BIGINT"""


RAW_TEXT = (
    "text_hits AS ("
    + "\nUNION ALL ".join(
        f"""SELECT doc_id, page, '{c}' AS category, {r} AS rk, unnest(ms) AS m, unnest(range(0, len(ms))) AS i FROM (
  SELECT doc_id, page, regexp_extract_all(page_text, '{p}', 1) AS ms FROM pages_t) WHERE len(ms) > 0"""
        for c, r, p in PATS
    )
    + f"""),
text_named AS (SELECT * EXCLUDE (m), {strip("m")} AS name FROM text_hits),
text_first AS (SELECT * FROM text_named WHERE length(name) >= 3
  QUALIFY row_number() OVER (PARTITION BY doc_id, page, category, lower(name) ORDER BY rk, i) = 1),
text_counted AS (SELECT f.*, {mentions("p.page_text", "f.name")} AS mentions
  FROM text_first f JOIN pages_t p USING (doc_id, page)),
from_text AS (SELECT doc_id, name, category, least(1.0::DOUBLE, mentions * 0.15::DOUBLE) AS importance, mentions,
  NULL::VARCHAR AS node_id, [1, page, rk, 0, i] AS o FROM text_counted)"""
)
RAW = "raw AS (SELECT * FROM from_ann UNION ALL SELECT * FROM from_text)"


def merged(src, out="merged"):
    return f"""{out} AS (SELECT doc_id, md5(doc_id || '/' || lower(name)) AS concept_id, arg_min(name, o) AS name,
  arg_min(category, o) AS category, sum(mentions)::BIGINT AS mentions, max(importance) AS importance
  FROM {src} GROUP BY doc_id, lower(name))"""


LINKS = """links AS (SELECT DISTINCT doc_id, md5(doc_id || '/' || lower(name)) AS concept_id, node_id FROM from_ann)"""
COOC = """cooc AS (SELECT a.doc_id, a.concept_id AS source_id, b.concept_id AS target_id, 'relates_to' AS relation_type,
  least(1.0::DOUBLE, count(*) * 0.25::DOUBLE) AS weight FROM links a JOIN links b ON a.node_id = b.node_id
  AND a.concept_id < b.concept_id GROUP BY 1, 2, 3)"""
UNITC = "unitc AS (SELECT DISTINCT doc_id, concept_id, unit_id FROM links JOIN members USING (doc_id, node_id))"
ANN = [ANNOTATED, DEDUPED, FROM_ANN]
TXT = [PAGES, RAW_TEXT, RAW]
SQL = {
    "concepts_from_annotations": with_(*ANN) + "SELECT node_id, name, category, importance FROM from_ann",
    "text_pattern_concepts": with_(*ANN, *TXT) + "SELECT doc_id, name, category, importance, mentions FROM from_text",
    "count_mentions": f"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '^{WS}*([^ \\t\\n]+)', 1) AS term FROM documents)
SELECT doc_id, term, {mentions("text", "term")} AS n FROM f WHERE term <> ''""",
    "merge_concepts": with_(*ANN, *TXT, merged("raw"))
    + """, places AS (SELECT doc_id, lower(name) AS k, node_id, min(o) AS o FROM raw WHERE node_id IS NOT NULL GROUP BY ALL),
held AS (SELECT md5(doc_id || '/' || k) AS concept_id, string_agg(node_id, chr(10) ORDER BY o) AS node_ids FROM places GROUP BY doc_id, k)
SELECT merged.*, coalesce(node_ids, '') AS node_ids, '' AS unit_ids, '' AS aliases FROM merged LEFT JOIN held USING (concept_id)""",
    "score_importance": with_(*ANN, *TXT, merged("raw"))
    + """SELECT * REPLACE (round_even(ln(1 + mentions) / ln(1 + greatest(1, max(mentions) OVER (PARTITION BY doc_id))), 3) AS importance)
FROM merged""",
    "map_concepts_to_units": with_(*ANN, FIXED, MEMBERS, LINKS, UNITC, recursive=True) + "SELECT concept_id, unit_id FROM unitc",
    "concept_cooccurrence": with_(*ANN, LINKS, COOC) + "SELECT * FROM cooc",
    "same_name_relation": with_(*ANN, *TXT)
    + """SELECT doc_id, lower(name) AS name, 1.0::DOUBLE AS weight FROM raw GROUP BY 1, 2
HAVING bool_or(category = 'definition') AND bool_or(category = 'vocab')""",
    "name_relations": with_(*ANN, *TXT, LINKS, COOC, merged("raw"))
    + """SELECT source_id, target_id, coalesce(a.name, '') AS source_name, coalesce(b.name, '') AS target_name FROM cooc
LEFT JOIN merged a ON a.concept_id = source_id AND a.category = 'definition'
LEFT JOIN merged b ON b.concept_id = target_id AND b.category = 'definition'""",
    "register_concept_strategy": with_(*ANN, *TXT)
    + "SELECT doc_id, o[1]::INTEGER AS strategy, count(*) AS n, sum(mentions)::BIGINT AS mentions FROM raw GROUP BY 1, 2",
}
