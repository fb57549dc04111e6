from oracles.base import NODES, WS, fold, strip, with_

BOXES = """boxes AS (SELECT doc_id, page, node_id, seq, node_type, text, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM nodes)"""
LINES2 = f"""lns AS (SELECT doc_id, page, node_id, seq AS node_seq, k::INTEGER AS line_no, k // 2 AS block,
  array_to_string(t[k * 6 + 1:k * 6 + 6], ' ') AS text, x0, x1, y0 + k % 10 * 0.01::DOUBLE AS y0, y0 + k % 10 * 0.01::DOUBLE + 0.009::DOUBLE AS y1,
  (['Courier', 'Times', 'Arial Bold'])[(seq % 3 + CASE WHEN seq % 2 = 0 THEN 0 ELSE k % 2 END) % 3 + 1] AS font,
  (9 + k % 2)::DOUBLE AS size, seq % 4 = 1 AS bold
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '{WS}+'), lambda z: z <> '') AS t FROM boxes) b,
    LATERAL (SELECT unnest(range(0, (greatest(len(t), 1) - 1) // 6 + 1)) AS k))"""
SQL = {
    "spatial_cover_anti_join": with_(NODES, BOXES)
    + """SELECT r.node_id AS rect_id FROM boxes r WHERE r.node_type IN ('equation', 'list') AND NOT EXISTS (SELECT 1 FROM boxes p
  WHERE p.doc_id = r.doc_id AND p.page = r.page AND p.node_type = 'figure'
    AND least(r.x1, p.x1) > greatest(r.x0, p.x0) AND least(r.y1, p.y1) > greatest(r.y0, p.y0)
    AND (least(r.x1, p.x1) - greatest(r.x0, p.x0)) * (least(r.y1, p.y1) - greatest(r.y0, p.y0)) / ((r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.5)""",
    "match_lines_in_box": with_(NODES, BOXES, LINES2)
    + f""", f AS (SELECT *, {fold("text")} AS ft FROM boxes), l AS (SELECT *, {fold("text")} AS ft FROM lns)
SELECT f.node_id, l.node_id AS line_of, l.line_no FROM f JOIN l USING (doc_id, page)
WHERE l.ft <> '' AND contains(f.ft, l.ft) AND l.x1 >= f.x0 - 0.004::DOUBLE AND f.x1 + 0.004::DOUBLE >= l.x0
  AND l.y1 >= f.y0 - 0.004::DOUBLE AND f.y1 + 0.004::DOUBLE >= l.y0""",
    "best_overlap_style": with_(NODES, BOXES, LINES2)
    + f""", f AS (SELECT *, lower({strip("text")}) AS ft FROM boxes), l AS (SELECT *, lower({strip("text")}) AS ft FROM lns),
p AS (SELECT f.node_id, l.font, l.size, l.bold, l.line_no, l.node_seq, greatest(0, least(f.x1 + 0.004::DOUBLE, l.x1) - greatest(f.x0 - 0.004::DOUBLE, l.x0))
    * greatest(0, least(f.y1 + 0.004::DOUBLE, l.y1) - greatest(f.y0 - 0.004::DOUBLE, l.y0)) AS area,
  f.ft <> '' AND (contains(f.ft, l.ft) OR contains(l.ft, f.ft)) AS same, l.ft AS lft FROM f JOIN l USING (doc_id, page)),
c AS (SELECT *, CASE WHEN area > 0 AND same THEN 3 WHEN area > 0 THEN 2 WHEN same AND lft <> '' THEN 1 END AS cls FROM p)
SELECT node_id, font, size, bold FROM boxes LEFT JOIN (SELECT * FROM c WHERE cls IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id
  ORDER BY cls DESC, CASE WHEN cls = 2 THEN area ELSE 0 END DESC, line_no, node_seq) = 1) USING (node_id)""",
    "split_by_block_and_style": with_(NODES, BOXES, LINES2)
    + """, g AS (SELECT node_id, block, count(*) AS n, bool_and(font = 'Courier') AS mono,
  count(DISTINCT (font, size, bold)) AS kinds, min(line_no) AS first FROM lns GROUP BY 1, 2),
s AS (SELECT l.*, CASE WHEN n > 1 AND (mono OR kinds > 1) THEN line_no ELSE first END AS segment FROM lns l JOIN g USING (node_id, block)),
o AS (SELECT node_id, segment, coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (text <> ''), '') AS text,
  first(font ORDER BY length(text) DESC, line_no) AS font, count(*) AS n_lines FROM s GROUP BY 1, 2)
SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY node_id) > 1""",
}
