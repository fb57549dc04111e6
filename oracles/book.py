from oracles.annotations import ANNOTATED
from oracles.base import LESSONS as LESSONS_T
from oracles.base import NODES, collapse, fold, strip, with_
from oracles.structure import FIXED
from oracles.units import MEMBERS, PROFILE

_CH = "('chapter', 'unit', 'module', 'part')"
_LE = "('lesson', 'section', 'topic', 'lab')"


def signals(src, out="sig"):
    return f"""{out} AS (SELECT doc_id, page, arg_min(t, seq) FILTER (kind = 'chapter') AS chapter_heading,
  arg_min(t, seq) FILTER (kind = 'lesson') AS lesson_heading FROM (SELECT doc_id, page, seq, t, CASE
    WHEN node_type <> 'heading' OR t = '' THEN NULL WHEN fw IN {_CH} THEN 'chapter' WHEN fw IN {_LE} THEN 'lesson'
    WHEN level <= 1 THEN 'chapter' WHEN level <= 2 THEN 'lesson' END AS kind
  FROM (SELECT *, {strip("text")} AS t, rtrim(lower(split_part({collapse("text")}, ' ', 1)), '.:') AS fw FROM {src})) GROUP BY 1, 2)"""


PLAIN = """plain AS (SELECT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN chapter_heading END AS chapter_heading,
  CASE WHEN doc_id % 2 = 0 THEN lesson_heading END AS lesson_heading FROM sig)"""


def segment(src, out="seg"):
    return f"""{out}_o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS ord, count(*) OVER (PARTITION BY doc_id) AS n,
    bool_or(lesson_heading IS NOT NULL) OVER (PARTITION BY doc_id) AS anchored FROM {src}),
{out}_k AS (SELECT n, CASE WHEN n <= 6 THEN 1 ELSE coalesce((SELECT arg_min(k, abs(n / k - 5) * 1000000 + k) FROM
    (SELECT unnest(range(1, 5000)) AS k) WHERE k <= n AND 4 * k <= n AND n <= 6 * k), greatest(1, round_even(n / 5, 0)::BIGINT)) END AS k
  FROM (SELECT DISTINCT n FROM {out}_o)),
{out}_s AS (SELECT o.*, CASE WHEN ord < (n % k) * (n // k + 1) THEN ord // (n // k + 1)
    ELSE n % k + (ord - (n % k) * (n // k + 1)) // (n // k) END AS chunk FROM {out}_o o JOIN {out}_k USING (n)),
{out} AS (SELECT *, (CASE WHEN anchored THEN sum(CASE WHEN lesson_heading IS NOT NULL AND ord > 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY page) ELSE chunk END)::BIGINT AS lesson FROM {out}_s)"""


LESSONS = """less AS (SELECT doc_id, lesson, min(page) AS first_page, max(page) AS last_page,
  coalesce(arg_min(lesson_heading, page) FILTER (lesson_heading IS NOT NULL),
    arg_min(chapter_heading, page) FILTER (chapter_heading IS NOT NULL), 'Lesson ' || (lesson + 1)) AS title,
  arg_min(chapter_heading, page) FILTER (chapter_heading IS NOT NULL) AS chapter_heading FROM seg GROUP BY doc_id, lesson),
chap_l AS (SELECT *, CASE WHEN bool_or(chapter_heading IS NOT NULL) OVER (PARTITION BY doc_id)
  THEN (sum(CASE WHEN chapter_heading IS NOT NULL AND lesson > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lesson))::BIGINT
  ELSE lesson // 5 END AS chapter FROM less),
chap AS (SELECT doc_id, chapter, count(*) AS n_lessons, coalesce(arg_min(chapter_heading, lesson) FILTER (chapter_heading IS NOT NULL),
  'Chapter ' || (chapter + 1)) AS title FROM chap_l GROUP BY doc_id, chapter)"""
ITEMS = f"""raw_items AS (SELECT * REPLACE (CASE WHEN seq % 6 = 1 THEN 'Study Guide for Content Mastery  ' || text
    WHEN seq % 10 = 4 THEN 'Name Date Class 12' WHEN seq % 10 = 9 THEN (seq % 7 + 1) || ') ' || lower(text) ELSE text END AS text) FROM nodes),
items AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1)::INTEGER AS item_order FROM (SELECT *, CASE node_type
    WHEN 'paragraph' THEN 'text' WHEN 'figure' THEN 'image' ELSE node_type END AS item_type FROM raw_items
  WHERE node_type <> 'page_header') WHERE item_type NOT IN ('text', 'list') OR {strip("text")} <> '')"""
QUEST = """quest AS (SELECT doc_id, page, node_id, seq, CASE seq % 4 WHEN 1 THEN 'question' WHEN 2 THEN 'list' ELSE 'text' END AS item_type,
  CASE WHEN seq % 4 = 1 THEN CASE WHEN seq % 12 = 5 THEN 'open' ELSE 'true_false' END END AS question_type,
  CASE WHEN seq % 4 = 2 AND seq % 3 <> 0 THEN 1 WHEN seq % 4 = 2 THEN 2 ELSE 0 END AS n_items,
  CASE seq % 4 WHEN 1 THEN (seq % 9) || '. ' || text WHEN 2 THEN (seq % 5) || ') ' || text ELSE lower(text) END AS text,
  (seq % 8 * 20)::DOUBLE AS y_pt, 10.0::DOUBLE AS h_pt FROM nodes)"""
DEDUPED = f"""ddp AS (SELECT * FROM fixed QUALIFY node_type <> 'heading' OR {fold("text")} = ''
  OR seq = min(CASE WHEN node_type = 'heading' THEN seq END) OVER (PARTITION BY doc_id, page, {fold("text")}))"""
BOOK = [NODES, FIXED, DEDUPED, signals("ddp"), PLAIN, segment("plain"), LESSONS]


def w(*c):
    return with_(*c, recursive=True)


OVERLAP = """us AS (SELECT m.doc_id, m.node_id, c.unit_id, c.seq::BIGINT AS unit_ord FROM members m JOIN counted c USING (doc_id, unit_id) WHERE m.level IS NOT NULL),
sg AS (SELECT n.doc_id, s.lesson AS segment, n.node_id FROM nodes n JOIN seg s USING (doc_id, page)),
shared AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, segment, unit_ord) AS i
  FROM (SELECT doc_id, segment, unit_ord, count(*) AS n FROM sg JOIN us USING (doc_id, node_id) GROUP BY 1, 2, 3)),
greedy(doc_id, i, got, used) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM sg
  UNION ALL
  SELECT g.doc_id, g.i + 1, CASE WHEN hit THEN list_append(got, segment) ELSE got END, CASE WHEN hit THEN list_append(used, unit_ord) ELSE used END
  FROM (SELECT g.*, s.segment, s.unit_ord, NOT list_contains(g.got, s.segment) AND NOT list_contains(g.used, s.unit_ord) AS hit
    FROM greedy g JOIN shared s ON s.doc_id = g.doc_id AND s.i = g.i + 1) g),
final AS (SELECT doc_id, arg_max(got, i) AS got, arg_max(used, i) AS used FROM greedy GROUP BY 1),
pairs AS (SELECT doc_id, unnest(got) AS segment, unnest(used) AS unit_ord FROM final),
todo AS (SELECT doc_id, segment, row_number() OVER (PARTITION BY doc_id ORDER BY segment) AS k
  FROM (SELECT DISTINCT doc_id, segment FROM sg) ANTI JOIN pairs USING (doc_id, segment)),
free AS (SELECT doc_id, unit_ord, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) AS k
  FROM (SELECT DISTINCT doc_id, unit_ord FROM us) ANTI JOIN pairs USING (doc_id, unit_ord)),
every AS (SELECT * FROM pairs UNION ALL SELECT t.doc_id, t.segment, f.unit_ord FROM todo t LEFT JOIN free f USING (doc_id, k))"""
RESOLVE = """ls AS (SELECT section_id AS course_id, lesson_id, lower(trim(title)) AS key, display_order,
  CASE WHEN lesson_id % 6 = 0 THEN 'p' || (lesson_id % 40) END AS plan_id FROM lessons),
bk AS (SELECT o_custkey AS course_id, l_suppkey AS ord, min(l_partkey) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
offers AS (SELECT course_id, key, list(lesson_id ORDER BY display_order, lesson_id) AS ids FROM ls GROUP BY 1, 2),
planned AS (SELECT course_id, plan_id, max(lesson_id) AS lesson_id FROM ls WHERE plan_id IS NOT NULL GROUP BY 1, 2),
asked AS (SELECT b.course_id, b.ord, row_number() OVER (PARTITION BY b.course_id ORDER BY b.ord) AS i, p.lesson_id AS planned,
    coalesce(x.ids, []) AS a, coalesce(y.ids, []) AS z
  FROM (SELECT *, ['1-urgent', '2-high', '3-medium', '4-not specified', '5-low'] AS names FROM bk) b
  LEFT JOIN planned p ON p.course_id = b.course_id AND p.plan_id = 'p' || (b.k % 40)
  LEFT JOIN offers x ON x.course_id = b.course_id AND x.key = names[b.k % 5 + 1]
  LEFT JOIN offers y ON y.course_id = b.course_id AND y.key = names[b.ord % 5 + 1]),
chosen(course_id, i, ord, lesson_id, used) AS (
  SELECT DISTINCT course_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM asked
  UNION ALL
  SELECT course_id, i, ord, c, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END
  FROM (SELECT q.course_id, q.i, q.ord, h.used, coalesce(q.planned, list_filter(q.a, lambda l: NOT list_contains(h.used, l))[1],
      list_filter(q.z, lambda l: NOT list_contains(h.used, l))[1]) AS c FROM chosen h JOIN asked q ON q.course_id = h.course_id AND q.i = h.i + 1))"""
SQL = {
    "assign_units_by_overlap": w(NODES, FIXED, DEDUPED, signals("ddp"), segment("sig"), MEMBERS, PROFILE, OVERLAP)
    + "SELECT e.doc_id, e.segment, u.unit_id FROM every e LEFT JOIN (SELECT DISTINCT doc_id, unit_ord, unit_id FROM us) u USING (doc_id, unit_ord)",
    "intersection_size": w(NODES, FIXED, DEDUPED, signals("ddp"), segment("sig"), MEMBERS, PROFILE, OVERLAP)
    + "SELECT doc_id, segment, unit_ord, n FROM shared",
    "resolve_lessons": w(LESSONS_T, RESOLVE) + "SELECT course_id, ord, lesson_id FROM chosen WHERE i > 0",
    "dedupe_page_headings": with_(NODES)
    + f""", h AS (SELECT * REPLACE (CASE WHEN node_type = 'heading' THEN ' Part  ' || seq % 3 ELSE text END AS text) FROM nodes)
SELECT node_id, text FROM h QUALIFY node_type <> 'heading' OR {fold("text")} = '' OR row_number() OVER
  (PARTITION BY doc_id, page, node_type, {fold("text")} ORDER BY seq) = 1""",
    "heading_signals": w(NODES, FIXED, signals("fixed")) + "SELECT * FROM sig",
    "segment_lessons_by_anchor": w(NODES, FIXED, DEDUPED, signals("ddp"), segment("sig")) + "SELECT doc_id, page, lesson FROM seg",
    "segment_lessons_by_size": w(NODES, FIXED, DEDUPED, signals("ddp"), PLAIN, segment("plain"))
    + "SELECT doc_id, page, lesson FROM seg WHERE lesson_heading IS NULL",
    "segment_titles": w(*BOOK) + "SELECT doc_id, lesson, first_page, last_page, title FROM less",
    "segment_chapters": w(*BOOK) + "SELECT * FROM chap",
    "nodes_to_items": with_(NODES)
    + f""", f AS (SELECT * REPLACE (CASE WHEN seq % 8 = 4 THEN 'form_area' WHEN seq % 8 IN (5, 6) THEN 'text_item' ELSE node_type END AS node_type)
  FROM nodes), k AS (SELECT *, CASE WHEN node_type IN ('paragraph', 'text_item') THEN 'text' WHEN node_type = 'figure' THEN 'image'
    ELSE node_type END AS item_type FROM f WHERE node_type <> 'page_header' AND seq % 8 <> 5)
SELECT node_id, item_type, (row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1)::INTEGER AS item_order FROM k
WHERE item_type NOT IN ('text', 'list') OR {strip("text")} <> ''""",
    "strip_page_chrome": with_(NODES, ITEMS)
    + f""", c AS (SELECT *, item_type IN ('text', 'heading') AS plain, trim({collapse("regexp_replace(regexp_replace(text, '(?i)study guide for content mastery', ' ', 'g'), '(?i)name date class( 12)?', ' ', 'g')")}, ' -•|' || chr(9) || chr(10)) AS c0,
  {fold("text")} AS f, y * 800 <= 45 OR y * 800 >= 745 AS margin FROM items),
d AS (SELECT *, CASE WHEN lower(c0) = 'class' OR regexp_matches(c0, '^\\d+$') THEN '' ELSE c0 END AS cl FROM c)
SELECT node_id, CASE WHEN plain THEN cl ELSE text END AS text FROM d WHERE NOT (plain AND ((margin AND (f IN ('class', 'name', 'date')
  OR contains(f, 'study guide for content mastery') OR contains(f, 'name date class'))) OR ({strip("text")} <> '' AND cl = '')))""",
    "drop_heading_echo": with_(NODES, recursive=True)
    + f""", hd AS (SELECT *, last_value(CASE WHEN node_type = 'heading' THEN struct_pack(s := seq, t := text) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hh FROM nodes),
e AS (SELECT doc_id, page, node_id, seq, CASE WHEN node_type = 'heading' THEN 'heading' ELSE 'text' END AS item_type,
  CASE WHEN node_type <> 'heading' AND seq - hh.s <= 2 AND seq % 4 <> 0 THEN '  ' || hh.t || ' ' ELSE text END AS text FROM hd),
o AS (SELECT *, {fold("text")} AS f, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS i FROM e),
walk(doc_id, page, i, node_id, item_type, kept, lt, lf) AS (SELECT doc_id, page, i, node_id, item_type, true, item_type, f FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.page, o.i, o.node_id, o.item_type, NOT (o.item_type = 'text' AND lt = 'heading' AND lf = f),
    CASE WHEN o.item_type = 'text' AND lt = 'heading' AND lf = f THEN lt ELSE o.item_type END,
    CASE WHEN o.item_type = 'text' AND lt = 'heading' AND lf = f THEN lf ELSE f END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.page = w.page AND o.i = w.i + 1)
SELECT node_id, item_type FROM walk WHERE kept""",
    "promote_true_false": with_(NODES, QUEST)
    + f""", q AS (SELECT *, try_cast(nullif(regexp_extract(text, '^\\s*(\\d+)[.)]\\s+', 1), '') AS BIGINT) AS n FROM quest),
p AS (SELECT *, coalesce((lag(question_type) OVER w = 'true_false' AND abs(lag(n) OVER w - n) <= 2), false)
    OR coalesce((lead(question_type) OVER w = 'true_false' AND abs(lead(n) OVER w - n) <= 2), false) AS near
  FROM q WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
u AS (SELECT *, item_type = 'list' AND n_items = 1 AND n IS NOT NULL AND near
  AND {strip("regexp_replace(text, '^\\s*(\\d+)[.)]\\s+', '')")} <> '' AS up FROM p)
SELECT node_id, CASE WHEN up THEN 'question' ELSE item_type END AS item_type,
  CASE WHEN up THEN 'true_false' ELSE question_type END AS question_type FROM u""",
    "join_question_continuation": with_(NODES, QUEST, recursive=True)
    + f""", o AS (SELECT doc_id, page, node_id, seq, CASE WHEN item_type = 'list' THEN 'text' ELSE item_type END AS item_type, question_type,
  lower(text) AS text, {strip("lower(text)")} AS t, y_pt, h_pt, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS i FROM quest),
walk(doc_id, page, i, head, item_type, qt, acc, bottom, joined) AS (
  SELECT doc_id, page, i, node_id, item_type, question_type, text, y_pt + h_pt, false FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.page, o.i, CASE WHEN ok THEN head ELSE node_id END, CASE WHEN ok THEN w.item_type ELSE o.item_type END,
    CASE WHEN ok THEN qt ELSE question_type END, CASE WHEN ok THEN {strip("rtrim(acc) || ' ' || t")} ELSE text END,
    CASE WHEN ok THEN bottom ELSE y_pt + h_pt END, ok
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.page = w.page AND o.i = w.i + 1, LATERAL (SELECT coalesce(o.item_type = 'text'
    AND w.item_type = 'question' AND qt = 'true_false' AND t <> '' AND NOT regexp_matches(t, '^[A-Z]') AND {strip("acc")} <> ''
    AND NOT regexp_matches({strip("acc")}, '[.?!:;]$') AND y_pt - bottom BETWEEN 0 AND 24, false) AS ok))
SELECT head AS node_id, any_value(item_type) AS item_type, arg_max(acc, i) AS text FROM walk GROUP BY head""",
    "reindex": with_(NODES, ITEMS)
    + """SELECT node_id, (row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1)::INTEGER AS item_order FROM items
WHERE item_type <> 'image'""",
    "item_text": with_(NODES, ITEMS)
    + f"SELECT node_id, CASE WHEN item_type = 'image' THEN '' ELSE {strip('text')} END AS item_text FROM items",
    "lesson_text": w(NODES, FIXED, DEDUPED, signals("ddp"), PLAIN, segment("plain"), ITEMS)
    + f"""SELECT doc_id, lesson, coalesce(string_agg({strip("text")}, chr(10) ORDER BY page, seq)
  FILTER (item_type <> 'image' AND {strip("text")} <> ''), '') AS lesson_text, count(*) AS n_items
FROM items JOIN seg USING (doc_id, page) GROUP BY 1, 2""",
    "page_label_histogram": with_(NODES)
    + """, c AS (SELECT doc_id, page, node_type, count(*) AS n FROM nodes GROUP BY 1, 2, 3),
p AS (SELECT doc_id, page, string_agg(DISTINCT doc_id || '/' || (seq - 1), ',' ORDER BY doc_id || '/' || (seq - 1)) AS parents
  FROM nodes WHERE seq % 4 = 1 GROUP BY 1, 2)
SELECT doc_id, page, string_agg(node_type || '=' || n, ',' ORDER BY node_type) AS labels, coalesce(any_value(parents), '') AS parents
FROM c LEFT JOIN p USING (doc_id, page) GROUP BY 1, 2""",
    "read_book_tree": w(*BOOK, ITEMS)
    + """SELECT i.doc_id, l.chapter, l.lesson, i.page, i.item_order, c.title AS chapter_title, l.title AS lesson_title, i.node_id
FROM items i JOIN seg s USING (doc_id, page) JOIN chap_l l USING (doc_id, lesson) JOIN chap c ON c.doc_id = l.doc_id AND c.chapter = l.chapter""",
    "nested_counts": w(*BOOK, ITEMS)
    + """SELECT doc_id, (SELECT count(*) FROM chap c WHERE c.doc_id = d.doc_id) AS chapters,
  (SELECT count(*) FROM less c WHERE c.doc_id = d.doc_id) AS lessons, (SELECT count(*) FROM seg c WHERE c.doc_id = d.doc_id) AS pages,
  (SELECT count(*) FROM items c WHERE c.doc_id = d.doc_id) AS items FROM (SELECT DISTINCT doc_id FROM seg) d""",
    "chapter_order_offset": w(*BOOK)
    + """, n AS (SELECT d.doc_id, d.doc_id % 5 AS course_id, (SELECT count(*) FROM chap c WHERE c.doc_id = d.doc_id) AS n FROM documents d),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY course_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
SELECT course_id, doc_id, chapter, (chapter + b)::BIGINT AS course_order FROM chap JOIN o USING (doc_id)""",
    "page_views": w(ANNOTATED, FIXED, MEMBERS)
    + """, pg AS (SELECT doc_id, page, coalesce(arg_min(text, seq) FILTER (node_type = 'heading'), '') AS title,
  coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (text <> '' AND node_type <> 'page_header'), '') AS full_text,
  left(full_text, 280) AS preview FROM nodes GROUP BY 1, 2),
u AS (SELECT doc_id, page, string_agg(DISTINCT unit_id, chr(10) ORDER BY unit_id) AS unit_ids FROM members GROUP BY 1, 2),
an AS (SELECT n.doc_id, n.page, concat_ws('/', a.node_id, a.type, a.ord) AS id, CASE WHEN a.type = 'key_term' THEN lower(a.term) END AS concept
  FROM anns a JOIN nodes n USING (node_id)),
ids AS (SELECT doc_id, page, string_agg(DISTINCT id, chr(10) ORDER BY id) AS annotation_ids,
  string_agg(DISTINCT concept, chr(10) ORDER BY concept) AS concept_ids FROM an GROUP BY 1, 2)
SELECT pg.*, coalesce(unit_ids, '') AS unit_ids, coalesce(annotation_ids, '') AS annotation_ids, coalesce(concept_ids, '') AS concept_ids, (SELECT count(DISTINCT unit_id) FROM members m WHERE m.doc_id = pg.doc_id AND m.page = pg.page) AS n_units,
  (SELECT count(DISTINCT a.node_id || type || ord) FROM anns a JOIN nodes n USING (node_id) WHERE n.doc_id = pg.doc_id AND n.page = pg.page)
    AS n_annotations,
  (SELECT count(DISTINCT lower(a.term)) FROM anns a JOIN nodes n USING (node_id) WHERE n.doc_id = pg.doc_id AND n.page = pg.page
    AND type = 'key_term') AS n_concepts FROM pg LEFT JOIN u USING (doc_id, page) LEFT JOIN ids USING (doc_id, page)""",
}
