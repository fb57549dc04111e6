from oracles.base import LINES, LOGS, NODES, RUNS, with_
from oracles.concepts import ANN, COOC, LINKS, UNITC, merged
from oracles.structure import FIXED
from oracles.units import MEMBERS, PROFILE, RANK, TYPED, parents

PRE = """ku AS (SELECT doc_id, unit_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS k FROM units),
pre AS (SELECT a.doc_id, a.unit_id, b.unit_id AS prerequisite_id FROM ku a JOIN ku b ON b.doc_id = a.doc_id
  AND b.k = a.k - 1 - a.k % 3 WHERE a.k % 2 = 0)"""
GRAPH = """vertices AS (SELECT doc_id, unit_id AS vertex, 'unit' AS node_type, title AS label, difficulty, minutes FROM units
  UNION ALL SELECT doc_id, concept_id, 'concept', name, NULL, NULL FROM merged),
edges AS (SELECT doc_id, parent_id AS src, unit_id AS dst, 'contains' AS edge_type, 1.0::DOUBLE AS weight FROM units
    WHERE parent_id IS NOT NULL
  UNION ALL SELECT doc_id, prerequisite_id, unit_id, 'depends_on', 1.0 FROM pre
  UNION ALL SELECT doc_id, unit_id, concept_id, 'references', 1.0 FROM unitc
  UNION ALL SELECT doc_id, source_id, target_id, 'references', weight FROM cooc)"""
ALL = [*ANN, FIXED, MEMBERS, PROFILE, TYPED, parents(RANK), LINKS, COOC, UNITC, merged("from_ann"), PRE, GRAPH]


def g(*extra):
    return with_(*ALL, *extra, recursive=True)


_STUCK = """, e AS (SELECT doc_id, n AS src, len % 37 AS dst FROM lines WHERE n <> len % 37),
up(doc_id, v, pp, d) AS (SELECT doc_id, src, dst, 1 FROM e
  UNION SELECT u.doc_id, u.v, e.dst, least(d + 1, 60) FROM up u JOIN e ON e.doc_id = u.doc_id AND e.src = u.pp WHERE d < 60),
looped AS (SELECT DISTINCT doc_id, v FROM up WHERE v = pp),
stuck AS (SELECT doc_id, v FROM looped UNION SELECT u.doc_id, u.pp FROM up u JOIN looped l ON l.doc_id = u.doc_id AND l.v = u.v)"""
SQL = {
    "is_dag": with_(LINES, recursive=True)
    + _STUCK
    + " SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM stuck) AS is_dag FROM documents",
    "artifact_counts": with_(NODES, LOGS, RUNS)
    + """SELECT doc_id, 'nodes' AS artifact, count(*) AS n FROM nodes GROUP BY 1
UNION ALL SELECT doc_id, 'headings', count(*) FROM nodes WHERE node_type = 'heading' GROUP BY 1
UNION ALL SELECT doc_id, 'pages', count(DISTINCT page) FROM nodes GROUP BY 1
UNION ALL SELECT doc_id, 'labels', count(*) FROM labels GROUP BY 1
UNION ALL SELECT doc_id, 'runs', count(*) FROM runs GROUP BY 1""",
    "build_edges": g() + "SELECT * FROM edges",
    "drop_dangling_edges": g("big AS (SELECT vertex FROM vertices WHERE node_type = 'unit' OR length(label) > 12)")
    + """SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT vertex FROM big) AND dst IN (SELECT vertex FROM big)""",
    "write_graph_tables": g()
    + """SELECT v.*, coalesce(n, 0) AS n_out FROM vertices v
LEFT JOIN (SELECT doc_id, src AS vertex, count(*) AS n FROM edges GROUP BY 1, 2) USING (doc_id, vertex)""",
    "graph_summary": g()
    + """SELECT doc_id, total_nodes, unit_nodes, concept_nodes, isolated_nodes, coalesce(total_edges, 0) AS total_edges,
  coalesce(c, 0) AS contains_edges, coalesce(d, 0) AS depends_on_edges, coalesce(r, 0) AS references_edges,
  0::BIGINT AS extends_edges, 0::BIGINT AS illustrates_edges, 0::BIGINT AS prerequisite_edges,
  coalesce(total_edges, 0) / total_nodes AS avg_out_degree
FROM (SELECT doc_id, count(*) AS total_nodes, count(*) FILTER (node_type = 'unit') AS unit_nodes,
    count(*) FILTER (node_type = 'concept') AS concept_nodes,
    count(*) FILTER (vertex NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS isolated_nodes FROM vertices GROUP BY 1)
LEFT JOIN (SELECT doc_id, count(*) AS total_edges, count(*) FILTER (edge_type = 'contains') AS c,
    count(*) FILTER (edge_type = 'depends_on') AS d, count(*) FILTER (edge_type = 'references') AS r FROM edges GROUP BY 1) USING (doc_id)""",
    "adjacency_list": g()
    + """SELECT v.doc_id, v.vertex, any_value(v.label || ' (' || v.node_type || ')') AS name,
  coalesce(string_agg(t.label || ' (' || e.edge_type || ')', '; ' ORDER BY t.label || ' (' || e.edge_type || ')'), '') AS targets
FROM vertices v LEFT JOIN edges e ON e.src = v.vertex LEFT JOIN vertices t ON t.vertex = e.dst GROUP BY 1, 2""",
    "direct_prerequisites": g() + "SELECT unit_id, prerequisite_id FROM pre",
    "cycle_members": with_(LINES, recursive=True)
    + _STUCK
    + """
SELECT s.doc_id, s.v::BIGINT AS vertex FROM stuck s JOIN lines n ON n.doc_id = s.doc_id AND n.n = s.v""",
}
