from oracles.base import LINES, NODES, WS, strip, with_, words

FIXED = """heads AS (SELECT doc_id, seq, level, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i
  FROM nodes WHERE node_type = 'heading'),
fold(doc_id, i, seq, e) AS (SELECT doc_id, i, seq, 1 FROM heads WHERE i = 1
  UNION ALL SELECT h.doc_id, h.i, h.seq, least(h.level, f.e + 1, 4) FROM fold f JOIN heads h
    ON h.doc_id = f.doc_id AND h.i = f.i + 1),
fixed AS (SELECT n.* EXCLUDE (level), coalesce(f.e, n.level)::INTEGER AS level FROM nodes n LEFT JOIN fold f USING (doc_id, seq))"""


def captions(src, out="capped"):
    return f"""{out}_1 AS (SELECT *, node_type = 'paragraph' AND regexp_matches(text, '(?i)^(Figure|Fig\\.?|Table|Equation|Eq\\.?)\\s*\\d+')
    AS cap FROM {src}),
{out}_2 AS (SELECT *, lag(CASE WHEN NOT cap THEN node_id END IGNORE NULLS) OVER w AS own_id,
    lag(CASE WHEN NOT cap THEN node_type END IGNORE NULLS) OVER w AS own_type
  FROM {out}_1 WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
{out}_3 AS (SELECT own_id, arg_max(text, seq) AS caption FROM {out}_2 WHERE cap AND own_type IN ('figure', 'equation') GROUP BY 1),
{out} AS (SELECT n.*, c.caption FROM {out}_2 n LEFT JOIN {out}_3 c ON c.own_id = n.node_id
  WHERE NOT (cap AND coalesce(own_type IN ('figure', 'equation'), false)))"""


def paragraphs(src, out, extra=""):
    return f"""{out}_1 AS (SELECT *, sum(CASE WHEN node_type <> 'paragraph' OR boundary_preserved THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY seq) AS run, node_type <> 'paragraph' OR boundary_preserved AS brk FROM {src}),
{out} AS (SELECT doc_id, min(seq) AS seq, arg_min(node_id, seq) AS node_id, any_value(node_type) AS node_type,
    {extra} list_reduce(list(text ORDER BY seq), lambda a, b: {strip("a || ' ' || b")}) AS text, count(*)::INTEGER AS n_merged
  FROM {out}_1 GROUP BY doc_id, run, brk)"""


def sections(src, out="placed"):
    return f"""{out}_h AS (SELECT doc_id, seq, node_id, level FROM {src} WHERE node_type = 'heading'),
{out}_o AS (SELECT n.doc_id, n.seq, max(h.seq) AS pseq FROM {src} n JOIN {out}_h h
    ON h.doc_id = n.doc_id AND h.seq < n.seq AND (n.node_type <> 'heading' OR h.level < n.level)
  WHERE NOT EXISTS (SELECT 1 FROM {out}_h b WHERE b.doc_id = h.doc_id AND b.seq > h.seq AND b.seq < n.seq AND b.level <= h.level)
  GROUP BY 1, 2),
{out} AS (SELECT n.*, n.doc_id || '/' || o.pseq AS parent_id FROM {src} n LEFT JOIN {out}_o o USING (doc_id, seq))"""


BASE = with_(NODES, FIXED, recursive=True)
PLACED = with_(NODES, FIXED, sections("fixed"), recursive=True)
TREE = """tree(doc_id, node, ancestor, distance) AS (SELECT doc_id, node_id, node_id, 0 FROM placed
  UNION ALL SELECT t.doc_id, t.node, p.parent_id, t.distance + 1 FROM tree t JOIN placed p
    ON p.node_id = t.ancestor WHERE p.parent_id IS NOT NULL)"""
COLS = """cols_1 AS (SELECT *, x - max(x + w) OVER (PARTITION BY doc_id, page ORDER BY x, y, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.05::DOUBLE AS gap FROM nodes),
cols AS (SELECT n.*, (CASE WHEN EXISTS (SELECT 1 FROM cols_1 g WHERE g.doc_id = n.doc_id AND g.page = n.page AND g.gap AND g.x <= n.x)
  THEN 1 ELSE 0 END)::INTEGER AS column_no FROM nodes n)"""
LISTED = """listed AS (SELECT doc_id, node_id, seq, text, CASE WHEN seq % 3 <> 0 THEN 'list' ELSE 'paragraph' END AS node_type,
  seq // 4 % 2 AS style, CASE WHEN seq > 0 AND seq % 5 = 4 THEN doc_id || '/' || (seq - 1) END AS parent_id FROM nodes),
l2 AS (SELECT *, node_type = 'list' AND coalesce(lag(node_type) OVER w = 'list' AND lag(style) OVER w = style
    AND coalesce(parent_id <> lag(node_id) OVER w, true) AND coalesce(lag(parent_id) OVER w <> node_id, true), false) AS same
  FROM listed WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
l3 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM l2)"""
CELLS = f"""toks AS (SELECT doc_id AS table_id, n AS row_index,
    list_filter(regexp_split_to_array(line, '{WS}+'), lambda t: t <> '') AS ts FROM lines),
trows AS (SELECT table_id, row_index, array_to_string(ts, ' | ') AS cells, row_index = 2 AND table_id % 2 = 0 AS is_header,
  len(ts) AS n FROM toks WHERE len(ts) > 0)"""

SQL = {
    "repair_heading_levels": BASE + "SELECT node_id, level FROM fixed",
    "attach_captions": with_(NODES, captions("nodes")) + "SELECT node_id, node_type, text, caption FROM capped",
    "merge_paragraphs": with_(NODES, paragraphs("nodes", "para")) + "SELECT node_id, node_type, text, n_merged FROM para",
    "merge_lists": with_(NODES, LISTED)
    + """SELECT arg_min(node_id, seq) AS node_id, any_value(node_type) AS node_type, string_agg(text, chr(10) ORDER BY seq) AS text,
  (CASE WHEN any_value(node_type) = 'list' THEN count(*) ELSE 0 END)::INTEGER AS n_items FROM l3 GROUP BY doc_id, run""",
    "assign_sections": PLACED + "SELECT node_id, parent_id FROM placed",
    "compose_passes": with_(
        NODES, FIXED, captions("fixed"),
        paragraphs("capped", "para", "any_value(level) AS level, any_value(caption) AS caption,"),
        sections("para"), recursive=True,
    )
    + "SELECT node_id, node_type, level, text, caption, parent_id, n_merged FROM placed",
    "group_pages": with_(NODES)
    + """SELECT DISTINCT doc_id, doc_id || '/page/' || page AS node_id, NULL::VARCHAR AS parent_id, page, 'page' AS node_type FROM nodes
UNION ALL SELECT doc_id, node_id, CASE WHEN seq % 4 = 1 THEN doc_id || '/' || (seq - 1) ELSE doc_id || '/page/' || page END, page, node_type
FROM nodes""",
    "reading_order": with_(NODES)
    + "SELECT node_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, seq) - 1 AS position FROM nodes",
    "assign_columns": with_(NODES, COLS) + "SELECT node_id, column_no FROM cols",
    "spatial_order": with_(NODES, FIXED, sections("fixed"), COLS, recursive=True)
    + """SELECT node_id, row_number() OVER (PARTITION BY doc_id, p.parent_id ORDER BY c.page, c.column_no, c.y, c.x, c.seq) - 1 AS position
FROM cols c JOIN placed p USING (doc_id, node_id)""",
    "propagate_bounds": with_(NODES, FIXED, sections("fixed"), TREE, recursive=True)
    + """SELECT t.doc_id, t.ancestor AS node_id, min(n.page) AS page, min(x) AS "left", min(y) AS top, max(x + w) AS "right",
  max(y + h) AS bottom FROM tree t JOIN nodes n ON n.node_id = t.node GROUP BY 1, 2""",
    "children_of": PLACED
    + """SELECT p.node_id, p.parent_id, (SELECT count(*) FROM placed c WHERE c.parent_id = p.node_id) AS n_children,
  (SELECT arg_min(c.node_id, c.seq) FROM placed c WHERE c.parent_id = p.node_id) AS first_child FROM placed p""",
    "dfs_sequence": with_(NODES, FIXED, sections("fixed"), TREE, recursive=True)
    + """, paths AS (SELECT t.doc_id, t.node, list(n.seq ORDER BY t.distance DESC) AS path, max(t.distance)::INTEGER AS depth
  FROM tree t JOIN nodes n ON n.node_id = t.ancestor GROUP BY 1, 2)
SELECT node AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS position, depth FROM paths""",
    "child_parent_repair": with_(LINES, recursive=True)
    + """, g AS (SELECT doc_id, n, CASE WHEN len % 5 <> 0 AND len * 7 % (cnt + 1) < cnt THEN (len * 7 % (cnt + 1))::INTEGER END AS p
  FROM lines JOIN (SELECT doc_id, count(*) AS cnt FROM lines GROUP BY 1) USING (doc_id)),
walk(doc_id, n, cur, path) AS (SELECT doc_id, n, n, [n] FROM g
  UNION ALL SELECT w.doc_id, w.n, g.p, list_append(w.path, g.p) FROM walk w JOIN g ON g.doc_id = w.doc_id AND g.n = w.cur
  WHERE g.p IS NOT NULL AND len(list_distinct(w.path)) = len(w.path)),
hit AS (SELECT doc_id, n, cur AS entry, list_min(path[list_position(path, cur):]) AS cyc FROM walk
  WHERE len(list_distinct(path)) < len(path)),
cut AS (SELECT doc_id, arg_max(entry, n) AS n FROM hit GROUP BY doc_id, cyc)
SELECT g.doc_id || '/' || g.n AS node_id, CASE WHEN c.n IS NULL THEN g.doc_id || '/' || g.p END AS parent_id
FROM g LEFT JOIN cut c ON c.doc_id = g.doc_id AND c.n = g.n""",
    "normalise_tables": with_(LINES)
    + f""", w AS (SELECT doc_id, n, {words("line")} AS k, list_filter(regexp_split_to_array(line, '{WS}+'), lambda t: t <> '') AS ts FROM lines)
SELECT doc_id, count(*)::INTEGER AS row_count, max(greatest(k, 1))::INTEGER AS column_count, count(*) > 1 AS first_is_header,
  CASE WHEN doc_id % 3 = 0 THEN 'A|B' ELSE coalesce(array_to_string(any_value(ts) FILTER (n = 0), '|'), '') END AS headers,
  sum(greatest(k, 1))::INTEGER AS n_cells FROM w GROUP BY doc_id""",
    "cells_to_rows": with_(LINES, CELLS)
    + """SELECT table_id, row_index, cells, is_header, count(*) OVER t AS row_count, max(n) OVER t::INTEGER AS column_count,
  coalesce(max(CASE WHEN is_header THEN cells END) OVER t, first_value(cells) OVER (PARTITION BY table_id ORDER BY row_index)) AS headers
FROM trows WINDOW t AS (PARTITION BY table_id)""".replace("max(n) OVER t::INTEGER", "(max(n) OVER t)::INTEGER"),
    "fold_list_items": with_(NODES)
    + """, b AS (SELECT *, seq % 5 AS slot, seq - seq % 5 AS base FROM nodes)
SELECT node_id, CASE WHEN slot = 4 THEN doc_id || '/' || base END AS parent_id,
  CASE WHEN slot = 4 THEN 'paragraph' ELSE 'list' END AS node_type, seq,
  CASE WHEN slot = 0 THEN coalesce((SELECT arg_min(c.list_style, c.seq) FROM b c WHERE c.doc_id = b.doc_id AND c.base = b.base
    AND c.slot IN (1, 2, 3)), list_style) ELSE list_style END AS list_style,
  CASE WHEN slot = 0 THEN coalesce((SELECT string_agg(c.text, chr(10) ORDER BY c.seq) FROM b c WHERE c.doc_id = b.doc_id
    AND c.base = b.base AND c.slot IN (1, 2, 3)), '') ELSE text END AS text,
  CASE WHEN slot = 0 THEN (SELECT count(*)::INTEGER FROM b c WHERE c.doc_id = b.doc_id AND c.base = b.base AND c.slot IN (1, 2, 3))
    ELSE 1 END AS n_items FROM b WHERE slot IN (0, 4)""",
    "synthesise_containers": """WITH r AS (SELECT page_id % 10 AS doc_id, '#' || regexp_replace(url, '^https?:/', '') AS ref FROM pages),
p AS (SELECT doc_id, ref, list_filter(string_split(substr(ref, 3), '/'), lambda x: x <> '') AS parts FROM r),
a AS (SELECT DISTINCT doc_id, '#/' || array_to_string(parts[1:k], '/') AS ref,
  CASE WHEN k > 1 THEN '#/' || array_to_string(parts[1:k - 1], '/') ELSE '#/body' END AS parent_ref,
  'AI-' || upper(rtrim(parts[1], 's')) AS label FROM p, LATERAL (SELECT unnest(range(1, len(parts))) AS k))
SELECT * FROM a WHERE (doc_id, ref) NOT IN (SELECT (doc_id, ref) FROM r)""",
    "hydrate_images": with_(NODES)
    + "SELECT doc_id, node_id, CASE WHEN contains(text, 'e') THEN sha256(text) END AS image FROM nodes WHERE node_type = 'figure'",
    "drop_non_content": with_(NODES) + "SELECT node_id, node_type FROM nodes WHERE node_type <> 'page_header'",
    "filter_page_range": with_(NODES) + "SELECT node_id, page FROM nodes WHERE page IN (2, 3)",
    "node_plain_text": with_(NODES, captions("nodes"))
    + """SELECT node_id, CASE WHEN node_type = 'page_header' THEN '' WHEN seq % 2 = 0 AND (node_type <> 'figure' OR text <> '') THEN text
  WHEN node_type = 'figure' THEN coalesce(caption, '') ELSE '' END AS plain FROM capped""",
    "project_content_nodes": with_(NODES)
    + f"""SELECT node_id, node_type AS kind, CASE WHEN node_type = 'heading' THEN level END AS level,
  CASE WHEN node_type = 'list' THEN list_style END AS style, CASE WHEN node_type = 'equation' THEN text END AS latex,
  CASE WHEN node_type IN ('heading', 'paragraph', 'list', 'code') THEN text END AS body
FROM nodes WHERE node_type NOT IN ('question', 'page_header') AND NOT (node_type = 'paragraph' AND {strip("text")} = '')""",
    "page_contexts": with_(NODES)
    + """SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (text <> '' AND node_type <> 'page_header'), '') AS page_text,
  arg_min(text, seq) FILTER (node_type = 'heading') AS heading, count(*) AS n_nodes FROM nodes GROUP BY 1, 2""",
    "text_preview": with_(NODES)
    + """SELECT doc_id, page, left(coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (text <> '' AND node_type <> 'page_header'), ''), 280)
  AS preview FROM nodes GROUP BY 1, 2""",
}
