from oracles.base import NODES, strip, with_
from oracles.structure import captions

# The detection patterns.
WB = r"(?:^|[^\p{L}\p{N}_])"
DEF = r"(?i)(?:Definition|Def\.?|Define)\s*(?:\d+[\.:)])?\s*[:\-–—]\s*(.+?)(?:\n|$)"
INLINE = WB + (
    r"([A-Za-z][a-zA-Z]+(?:\s[A-Za-z][a-zA-Z]+)*)\s+(?:is|are|refers to|means|denotes)\s+(.+?)(?:\.|;|,|\n|$)"
)
EX = "(?i)" + WB + r"((?:Example|Ex\.|For instance|Consider|Observe)\s*(?:\d+[\.:)])?\s*[:\-–—]?\s*(?:.*))"
NEG = "(?i)" + WB + r"(?:Non-?example|Counterexample|Incorrect|Wrong)"
EXER = "(?i)" + WB + r"(?:Exercise|Problem|Question|Practice|Quiz)(?:\s+\d+)?\s*[:\-–—]"
OBJ = (
    r"(?i)(?:Learning Objective|Objective|Outcome|After completing|By the end|Students will|You will|Aim|Goal)\s*"
    r"(?:\d+[\.:)])?\s*[:\-–—]?\s*(.+?)(?:\n|$)"
)
SUM = (
    r"(?im)^\s*(?:Summary|Recap|Review|Key Takeaways?|Chapter Summary|Section Summary|In summary|To summarize"
    r"|In conclusion|Conclusion)"
)
CALL = (
    r"(?i)((?:Note|Tip|Warning|Caution|Important|Remember|Info|Danger|Key Point|Did you know)\s*"
    r"(?:\d+[\.:)])?\s*[:\-–—]?\s*(?:.*))"
)
LAB = r"(?i)(?:Section|Chapter|Figure|Fig\.?|Table|Equation|Eq\.?|Appendix)\s*(\d+(?:\.\d+)*)"
REF = r"(?i)(?:see|refer to|as shown in|as discussed in|from|in)\s+(?:Section|Chapter|Figure|Fig\.?|Table|Equation|Eq\.?|Appendix)\s*(\d+(?:\.\d+)*)"
BOLD = r"\*\*(.*?[\p{L}\p{N}_])\*\*"
SITE = "(?i)" + WB + r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\s+(?:is|are|refers to|means|denotes|is defined as)\s+"

BODY = "doc_id, node_id, seq"
TEXTUAL = "node_type IN ('paragraph', 'heading')"


def _many(name, type_, where, conf, offset, cols, src):
    """Rows of zipped match lists: cols maps output name to an expression over list items a, b."""
    return f"""{name}_m AS (SELECT {BODY}, text, unnest(la) AS a, unnest(lb) AS b, unnest(range(0, len(la)))::INTEGER AS i
  FROM (SELECT *, {cols["la"]} AS la, {cols["lb"]} AS lb FROM {src} WHERE {where}) WHERE len(la) > 0),
{name} AS (SELECT {BODY}, '{type_}' AS type, i + {offset} AS ord, {conf}::DOUBLE AS confidence, {cols["term"]} AS term,
  {cols["body"]} AS body, {cols.get("kind", "NULL::VARCHAR")} AS kind FROM {name}_m)"""


def _x(pat, g):
    return f"regexp_extract_all(text, '{pat}', {g})"


def _title(v):
    return f"""array_to_string(list_transform(regexp_extract_all({v}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1),
  lambda w: upper(w[1]) || lower(w[2:])), '')"""


def ctes(src):
    word = f"lower({strip(f'''split_part(split_part(regexp_extract(text, '{CALL}', 1), ':', 1), '.', 1)''')})"
    return ",\n".join(
        [
            _many("a_def", "definition", TEXTUAL, 0.9, 0, {
                "la": _x(DEF, 0), "lb": _x(DEF, 1),
                "term": f"CASE WHEN contains(a, ':') THEN {strip('''split_part(a, ':', 1)''')} ELSE 'Definition' END",
                "body": strip("b")}, src),
            _many("a_inl", "definition", TEXTUAL, 0.7, 1000000, {
                "la": _x(INLINE, 1), "lb": _x(INLINE, 2), "term": strip("a"), "body": strip("b")}, src),
            f"""a_exa AS (SELECT {BODY}, 'example' AS type, 0 AS ord, 0.85::DOUBLE AS confidence, CASE
    WHEN regexp_matches(text, '{NEG}') THEN 'Non-example' WHEN contains(r, ':') THEN {strip("split_part(r, ':', 1)")}
    ELSE 'Example' END AS term, text AS body, CASE WHEN regexp_matches(text, '{NEG}') THEN 'negative' ELSE 'positive' END AS kind
  FROM (SELECT *, regexp_extract(text, '{EX}', 1) AS r FROM {src})
  WHERE {TEXTUAL} AND (regexp_matches(text, '{NEG}') OR regexp_matches(text, '{EX}')))""",
            f"""a_exe AS (SELECT {BODY}, 'exercise' AS type, 0 AS ord, (CASE WHEN node_type = 'question' THEN 1.0 ELSE 0.75 END)::DOUBLE AS confidence,
  NULL::VARCHAR AS term, text AS body, 'unknown' AS kind FROM {src}
  WHERE node_type = 'question' OR ({TEXTUAL} AND regexp_matches(text, '{EXER}')))""",
            _many("a_obj", "objective", TEXTUAL, 0.85, 0, {
                "la": _x(OBJ, 0), "lb": _x(OBJ, 1), "term": "NULL::VARCHAR",
                "body": f"CASE WHEN {strip('b')} <> '' THEN {strip('b')} ELSE {strip('a')} END"}, src),
            f"""a_sum AS (SELECT {BODY}, 'summary' AS type, 0 AS ord, 0.85::DOUBLE AS confidence, NULL::VARCHAR AS term, text AS body,
  NULL::VARCHAR AS kind FROM {src} WHERE {TEXTUAL} AND regexp_matches(text, '{SUM}'))""",
            f"""a_cal AS (SELECT {BODY}, 'callout' AS type, 0 AS ord, 0.8::DOUBLE AS confidence, {_title("cw")} AS term, text AS body,
  CASE WHEN cw IN ('tip', 'did you know') THEN 'example' WHEN cw IN ('important', 'remember', 'key point') THEN 'reminder'
    WHEN cw IN ('warning', 'caution', 'danger') THEN 'non_example' ELSE 'info' END AS kind
  FROM (SELECT *, {word} AS cw FROM {src}) WHERE node_type = 'paragraph' AND regexp_matches(text, '{CALL}'))""",
            _many("a_ref", "cross_reference", TEXTUAL, 0.85, 0, {
                "la": _x(REF, 0), "lb": _x(REF, 1), "term": strip("a"), "body": "b"}, src),
            f"""a_lab AS (SELECT {BODY}, 'cross_reference' AS type,
  (row_number() OVER (PARTITION BY node_id ORDER BY min(i)) - 1 + 1000000)::INTEGER AS ord, 0.6::DOUBLE AS confidence, a AS term,
  any_value(b) AS body, NULL::VARCHAR AS kind FROM (SELECT {BODY}, unnest(la) AS a, unnest(lb) AS b, unnest(range(0, len(la))) AS i
    FROM (SELECT *, list_transform({_x(LAB, 0)}, lambda z: trim(z)) AS la, {_x(LAB, 1)} AS lb FROM {src} WHERE node_type = 'paragraph')
    WHERE len(la) > 0) l
  WHERE NOT EXISTS (SELECT 1 FROM a_ref r WHERE r.node_id = l.node_id AND r.term = l.a) GROUP BY doc_id, node_id, seq, a)""",
            _many("a_bold", "key_term", TEXTUAL, 0.9, 0, {
                "la": _x(BOLD, 1), "lb": _x(BOLD, 1), "term": strip("a"), "body": "text"}, src),
            _many("a_site", "key_term", TEXTUAL, 0.7, 1000000, {
                "la": _x(SITE, 1), "lb": _x(SITE, 1), "term": strip("a"), "body": "text"}, src),
            "a_term AS (SELECT * FROM a_bold UNION ALL SELECT * FROM a_site)",
            """a_first AS (SELECT * FROM a_term WHERE term <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY seq, ord) = 1)""",
        ]
    )


ASSOC = """assoc AS (SELECT *, lead(node_type) OVER w AS nt, lead(text) OVER w AS nx FROM capped
  WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
a_fig AS (SELECT doc_id, node_id, seq, 'figure_association' AS type, 0 AS ord,
  (CASE WHEN caption <> '' THEN 0.9 ELSE 0.5 END)::DOUBLE AS confidence, NULL::VARCHAR AS term,
  coalesce(nullif(caption, ''), CASE WHEN nt = 'paragraph' THEN nx END, '') AS body, NULL::VARCHAR AS kind
  FROM assoc WHERE node_type = 'figure'),
a_equ AS (SELECT doc_id, node_id, seq, 'equation_association' AS type, 0 AS ord, 0.9::DOUBLE AS confidence,
  'Eq. ' || node_id AS term, coalesce(nullif(caption, ''), CASE WHEN nt = 'paragraph' THEN nx END, '') AS body,
  NULL::VARCHAR AS kind FROM assoc WHERE node_type = 'equation')"""
DETECTORS = {
    "definition": ("DefinitionDetector", 0, ["a_def", "a_inl"]), "example": ("ExampleDetector", 1, ["a_exa"]),
    "exercise": ("ExerciseDetector", 2, ["a_exe"]), "objective": ("ObjectiveDetector", 3, ["a_obj"]),
    "summary": ("SummaryDetector", 4, ["a_sum"]), "callout": ("CalloutDetector", 5, ["a_cal"]),
    "cross_reference": ("CrossReferenceDetector", 6, ["a_ref", "a_lab"]), "key_term": ("KeyTermDetector", 7, ["a_first"]),
    "figure_association": ("FigureAssociationDetector", 8, ["a_fig"]),
    "equation_association": ("EquationAssociationDetector", 9, ["a_equ"]),
}
ALL = "anns AS (" + "\nUNION ALL ".join(
    f"SELECT *, '{d}' AS detector, {i} AS emit FROM {t}" for d, i, ts in DETECTORS.values() for t in ts
) + ")"
ANNOTATED = NODES + ",\n" + captions("nodes") + ",\n" + ctes("capped") + ",\n" + ASSOC + ",\n" + ALL
OUT = "node_id, ord, confidence, term, body, kind"


def _single(*tables):
    return with_(NODES, ctes("nodes")) + " UNION ALL ".join(f"SELECT {OUT} FROM {t}" for t in tables)


SQL = {
    "detect_definitions": _single("a_def", "a_inl"),
    "detect_examples": _single("a_exa"),
    "detect_exercises": _single("a_exe"),
    "detect_objectives": _single("a_obj"),
    "detect_summaries": _single("a_sum"),
    "detect_callouts": _single("a_cal"),
    "detect_cross_refs": _single("a_ref", "a_lab"),
    "detect_key_terms": _single("a_term"),
    "first_occurrence_terms": with_(NODES, ctes("nodes")) + f"SELECT doc_id, {OUT} FROM a_first",
    "figure_nearby_text": with_(NODES, captions("nodes"), ASSOC) + "SELECT node_id, confidence, term, body FROM a_fig",
    "equation_nearby_text": with_(NODES, captions("nodes"), ASSOC) + "SELECT node_id, confidence, term, body FROM a_equ",
    "register_detector": with_(ANNOTATED)
    + "SELECT doc_id, type, detector, count(*) AS n, max(confidence) AS top FROM anns GROUP BY 1, 2, 3",
    "dedupe_annotations": with_(ANNOTATED)
    + """SELECT node_id, type, confidence, term, body FROM anns
QUALIFY row_number() OVER (PARTITION BY type, node_id ORDER BY confidence DESC, emit, ord) = 1""",
}
