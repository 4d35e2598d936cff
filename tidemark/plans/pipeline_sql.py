"""The SQL of p1 to p5 for a second engine, each written another way than the operator."""

P2 = """
WITH RECURSIVE links AS (
  SELECT DISTINCT 'table' AS tree, CAST(db_id AS VARCHAR) AS scope_key, tid AS n, parent_table_id AS a
  FROM ddl_log WHERE op = 'drop_table'
  UNION
  SELECT DISTINCT 'role', m.fdw_id, m.member_oid, m.role_oid FROM role_member_snapshot_history m
  JOIN (SELECT fdw_id, max(snapshot_time) AS t FROM role_member_snapshot_history GROUP BY fdw_id) l
    ON m.fdw_id = l.fdw_id AND m.snapshot_time = l.t),
nodes AS (SELECT tree, scope_key, n FROM links UNION SELECT tree, scope_key, a FROM links WHERE a IS NOT NULL),
edges AS (SELECT * FROM links WHERE a IS NOT NULL),
walk AS (
  SELECT tree, scope_key, n, a, 1 AS depth, [n, a] AS seen FROM edges
  UNION ALL
  SELECT w.tree, w.scope_key, w.n, e.a, w.depth + 1, list_append(w.seen, e.a)
  FROM walk w JOIN edges e ON e.tree = w.tree AND e.scope_key = w.scope_key AND e.n = w.a
  WHERE w.n <> w.a AND NOT list_contains(w.seen[2:], e.a)),
cyc AS (SELECT DISTINCT tree, scope_key, n FROM walk WHERE n = a),
roots AS (SELECT * FROM nodes x WHERE NOT EXISTS (
  SELECT 1 FROM edges e WHERE e.tree = x.tree AND e.scope_key = x.scope_key AND e.n = x.n)),
best AS (
  SELECT w.tree, w.scope_key, w.n, w.a AS root, min(w.depth) AS depth
  FROM walk w JOIN roots r ON r.tree = w.tree AND r.scope_key = w.scope_key AND r.n = w.a GROUP BY ALL
  UNION ALL SELECT tree, scope_key, n, n, 0 FROM roots)
SELECT x.tree, x.scope_key, x.n AS node_id,
       CASE WHEN c.n IS NOT NULL THEN -1 ELSE coalesce(b.root, -1) END AS root_id,
       CAST(CASE WHEN c.n IS NOT NULL THEN -1 ELSE coalesce(b.depth, -2) END AS INTEGER) AS node_depth
FROM nodes x
LEFT JOIN cyc c ON c.tree = x.tree AND c.scope_key = x.scope_key AND c.n = x.n
LEFT JOIN best b ON b.tree = x.tree AND b.scope_key = x.scope_key AND b.n = x.n AND c.n IS NULL
"""


def _diff(table: str, key: str, plain: list[str], sets: list[str], quals: list[str]) -> str:
    as_set = lambda c: f"list_sort(list_distinct(coalesce({c}, [])))"
    sq = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    state = ", ".join([*plain, *[f"{as_set(c)} AS {c}" for c in sets], *[f"{sq(c)} AS {c}" for c in quals]])
    cols = [*plain, *sets, *quals]
    differ = " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in cols)
    return f"""
SELECT '{table}' AS source_table, coalesce(n.fdw_id, o.fdw_id) AS fdw_id, coalesce(n.{key}, o.{key}) AS record_oid,
       strftime(coalesce(n.snapshot_time, o.later), '%Y-%m-%d %H:%M:%S') AS snapshot_at,
       CASE WHEN o.{key} IS NULL THEN 'added' WHEN n.{key} IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT r.*, s.before FROM {table}_r r JOIN {table}_s s USING (fdw_id, snapshot_time) WHERE s.before IS NOT NULL) n
FULL JOIN (SELECT r.*, s.later FROM {table}_r r JOIN {table}_s s USING (fdw_id, snapshot_time) WHERE s.later IS NOT NULL) o
  ON n.fdw_id = o.fdw_id AND n.{key} = o.{key} AND n.before = o.snapshot_time
WHERE n.{key} IS NULL OR o.{key} IS NULL OR {differ}
""", f"""
{table}_r AS (SELECT fdw_id, snapshot_time, {key}, {state} FROM (
  SELECT *, row_number() OVER (PARTITION BY fdw_id, snapshot_time, {key} ORDER BY ingested_at DESC) AS rn FROM {table}) x WHERE rn = 1),
{table}_s AS (SELECT fdw_id, snapshot_time, lag(snapshot_time) OVER w AS before, lead(snapshot_time) OVER w AS later
  FROM (SELECT DISTINCT fdw_id, snapshot_time FROM {table}) x WINDOW w AS (PARTITION BY fdw_id ORDER BY snapshot_time))
"""


_r = _diff("role_snapshot_history", "role_oid", ["rolname", "rolsuper", "rolinherit", "rolcanlogin", "rolbypassrls"], ["rolconfig"], [])
_p = _diff("policy_snapshot_history", "policy_oid", ["policy_name", "policy_permissive"], ["policy_roles"], ["policy_qual"])
P3 = f"WITH {_r[1]}, {_p[1]} {_r[0]} UNION ALL {_p[0]}"

P4 = """
WITH req AS (SELECT DISTINCT request_id, db_id, table_id, col_position, schema_xid, requested_at FROM xid_request WHERE schema_xid IS NOT NULL),
hist AS (
  SELECT request_id, history_id, col_exists FROM (
    SELECT r.request_id, h.history_id, h.col_exists,
           row_number() OVER (PARTITION BY r.request_id ORDER BY h.xid DESC, h.lsn DESC, h.recorded_at DESC) AS rn
    FROM req r JOIN column_history h ON h.db_id = r.db_id AND h.table_id = r.table_id AND h.col_position = r.col_position
     AND h.xid <= r.schema_xid AND h.recorded_at <= r.requested_at) x WHERE rn = 1),
push AS (
  SELECT r.request_id, max(p.xid) AS push_xid FROM req r JOIN xid_push p ON p.db_id = r.db_id
   AND p.xid <= r.schema_xid AND p.pushed_at <= r.requested_at WHERE p.has_schema_changes AND p.real_commit GROUP BY 1)
SELECT h.request_id, h.history_id, p.push_xid FROM hist h LEFT JOIN push p USING (request_id) WHERE h.col_exists
"""


def _snap_orphans(name: str, child: str, parent: str, record: str, ref: str, key: str) -> str:
    return f"""
SELECT DISTINCT '{name}' AS source_table, c.fdw_id AS scope_key, c.{record} AS record_id, c.{ref} AS ref_id,
  strftime(c.snapshot_time, '%Y-%m') AS ref_month,
  CASE WHEN k.first_t < c.snapshot_time THEN 'deleted' WHEN k.last_t > c.snapshot_time THEN 'later' ELSE 'missing' END AS ref_status
FROM {child} c
LEFT JOIN (SELECT fdw_id, {key} AS k, min(snapshot_time) AS first_t, max(snapshot_time) AS last_t FROM {parent} GROUP BY 1, 2) k
  ON k.fdw_id = c.fdw_id AND k.k = c.{ref}
WHERE c.{ref} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT x.fdw_id, x.t, p.{key} AS k FROM
      (SELECT a.fdw_id, a.snapshot_time AS t, max(b.snapshot_time) AS last_t
       FROM (SELECT DISTINCT fdw_id, snapshot_time FROM {child}) a JOIN (SELECT DISTINCT fdw_id, snapshot_time FROM {parent}) b
         ON a.fdw_id = b.fdw_id AND b.snapshot_time <= a.snapshot_time GROUP BY 1, 2) x
      JOIN {parent} p ON p.fdw_id = x.fdw_id AND p.snapshot_time = x.last_t) v
  WHERE v.fdw_id = c.fdw_id AND v.t = c.snapshot_time AND v.k = c.{ref})
"""


P5 = f"""
WITH pol AS (SELECT fdw_id, snapshot_time, policy_oid, table_oid FROM (
  SELECT *, row_number() OVER (PARTITION BY fdw_id, snapshot_time, policy_oid ORDER BY ingested_at DESC, table_oid DESC) AS rn
  FROM policy_snapshot_history) x WHERE rn = 1),
made AS (SELECT db_id, tid, min(CAST(xid AS HUGEINT) * 1000000000000000 + lsn) AS p FROM ddl_log WHERE op = 'create_table' GROUP BY 1, 2),
gone AS (SELECT db_id, tid, min(CAST(xid AS HUGEINT) * 1000000000000000 + lsn) AS p FROM ddl_log WHERE op = 'drop_table' GROUP BY 1, 2)
{_snap_orphans('policy_snapshot_history', 'pol', 'table_owner_snapshot_history', 'policy_oid', 'table_oid', 'table_oid')}
UNION ALL
{_snap_orphans('table_owner_snapshot_history', 'table_owner_snapshot_history', 'role_snapshot_history', 'table_oid', 'role_owner_oid', 'role_oid')}
UNION ALL
SELECT * FROM (
  SELECT DISTINCT 'ddl_log' AS source_table, CAST(l.db_id AS VARCHAR) AS scope_key, l.tid AS record_id, l.parent_table_id AS ref_id,
    strftime(l.committed_at, '%Y-%m') AS ref_month,
    CASE WHEN m.p IS NULL THEN 'missing'
         WHEN m.p > CAST(l.xid AS HUGEINT) * 1000000000000000 + l.lsn THEN 'later'
         WHEN g.p < CAST(l.xid AS HUGEINT) * 1000000000000000 + l.lsn THEN 'deleted' END AS ref_status
  FROM ddl_log l LEFT JOIN made m ON m.db_id = l.db_id AND m.tid = l.parent_table_id
  LEFT JOIN gone g ON g.db_id = l.db_id AND g.tid = l.parent_table_id
  WHERE l.op = 'drop_table' AND l.parent_table_id IS NOT NULL) z WHERE ref_status IS NOT NULL
"""

P1 = """
WITH rec AS (
  SELECT db_id, tid, xid, lsn, op, schema_name || '.' || table_name AS name, ddl_columns FROM (
    SELECT *, row_number() OVER (PARTITION BY tid, xid, lsn ORDER BY received_at DESC) AS rn FROM ddl_log) x WHERE rn = 1),
line AS (SELECT *, lag(name) OVER w AS prev_name, lead(xid) OVER w AS next_xid FROM rec WINDOW w AS (PARTITION BY tid ORDER BY xid, lsn)),
ver AS (SELECT tid, xid, lsn, lag(xid) OVER w AS p_xid, lag(lsn) OVER w AS p_lsn, lead(xid) OVER w AS n_xid,
    ddl_columns[1].name AS key FROM rec WHERE op = 'create_table' WINDOW w AS (PARTITION BY tid ORDER BY xid, lsn)),
flat AS (SELECT tid, xid, lsn, unnest(ddl_columns) AS c FROM rec WHERE op = 'create_table'),
col AS (SELECT f.tid, f.xid, f.lsn, f.c.name AS name,
    CASE WHEN f.c.type_oid <> 0 THEN CAST(f.c.type_oid AS VARCHAR) ELSE coalesce(CAST(t.type_oid AS VARCHAR), lower(f.c.type_name)) END AS type
  FROM flat f LEFT JOIN type_catalog t ON lower(t.type_name) = lower(f.c.type_name)),
pair AS (SELECT * FROM ver WHERE p_xid IS NOT NULL),
gone AS (SELECT p.tid, p.xid, p.lsn, c.name, c.type FROM pair p JOIN col c ON c.tid = p.tid AND c.xid = p.p_xid AND c.lsn = p.p_lsn
  WHERE NOT EXISTS (SELECT 1 FROM col n WHERE n.tid = p.tid AND n.xid = p.xid AND n.lsn = p.lsn AND n.name = c.name)),
came AS (SELECT p.tid, p.xid, p.lsn, c.name, c.type FROM pair p JOIN col c ON c.tid = p.tid AND c.xid = p.xid AND c.lsn = p.lsn
  WHERE NOT EXISTS (SELECT 1 FROM col o WHERE o.tid = p.tid AND o.xid = p.p_xid AND o.lsn = p.p_lsn AND o.name = c.name)),
held AS (SELECT DISTINCT d.db_id, d.schema_name, d.table_name, d.xid AS f_xid, l.tid
  FROM (SELECT DISTINCT db_id, schema_name, table_name, xid FROM table_dump) d
  JOIN line l ON l.db_id = d.db_id AND l.name = d.schema_name || '.' || d.table_name AND l.xid <= d.xid
   AND (l.next_xid IS NULL OR l.next_xid > d.xid) AND l.op <> 'drop_table'),
file AS (SELECT h.*, v.xid AS v_xid, v.lsn AS v_lsn, v.key FROM held h JOIN ver v ON v.tid = h.tid AND v.xid <= h.f_xid AND (v.n_xid IS NULL OR v.n_xid > h.f_xid)),
doc AS (SELECT DISTINCT f.tid, f.v_xid, f.v_lsn, t.payload, json_extract_string(t.payload, '$."' || f.key || '"') AS k
  FROM table_dump t JOIN file f ON f.db_id = t.db_id AND f.schema_name = t.schema_name AND f.table_name = t.table_name AND f.f_xid = t.xid),
val AS (
  SELECT g.tid, g.xid, g.lsn, g.name AS old_name, c.name AS new_name, o.k,
         json_extract_string(o.payload, '$."' || g.name || '"') AS a, json_extract_string(n.payload, '$."' || c.name || '"') AS b
  FROM gone g JOIN came c ON c.tid = g.tid AND c.xid = g.xid AND c.lsn = g.lsn
  JOIN pair p ON p.tid = g.tid AND p.xid = g.xid AND p.lsn = g.lsn
  JOIN doc o ON o.tid = p.tid AND o.v_xid = p.p_xid AND o.v_lsn = p.p_lsn
  JOIN doc n ON n.tid = p.tid AND n.v_xid = p.xid AND n.v_lsn = p.lsn AND n.k = o.k),
ren AS (SELECT tid, xid, lsn, old_name, new_name FROM val WHERE a IS NOT NULL OR b IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5 HAVING 2 * count(*) FILTER (WHERE a = b) > count(*)),
same AS (SELECT p.tid, p.xid, p.lsn, o.name AS old_name, n.name AS new_name, o.type AS a, n.type AS b FROM pair p
  JOIN col o ON o.tid = p.tid AND o.xid = p.p_xid AND o.lsn = p.p_lsn JOIN col n ON n.tid = p.tid AND n.xid = p.xid AND n.lsn = p.lsn
  LEFT JOIN ren r ON r.tid = p.tid AND r.xid = p.xid AND r.lsn = p.lsn AND r.old_name = o.name AND r.new_name = n.name
  WHERE o.name = n.name OR r.tid IS NOT NULL)
SELECT tid, xid, lsn, 'renamed' AS change_kind, old_name, new_name FROM ren
UNION ALL SELECT tid, xid, lsn, 'removed', name, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.tid = g.tid AND r.xid = g.xid AND r.lsn = g.lsn AND r.old_name = g.name)
UNION ALL SELECT tid, xid, lsn, 'added', '', name FROM came g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.tid = g.tid AND r.xid = g.xid AND r.lsn = g.lsn AND r.new_name = g.name)
UNION ALL SELECT tid, xid, lsn, 'retyped', old_name, new_name FROM same WHERE a <> b
UNION ALL SELECT tid, xid, lsn, CASE op WHEN 'rename_table' THEN 'table_renamed' ELSE 'schema_moved' END, prev_name, name FROM line
  WHERE op IN ('rename_table', 'set_namespace') AND prev_name <> name
"""

_P2_HEAD = P2[: P2.index("best AS (")]
P2_PATHS = _P2_HEAD + """
way AS (
  SELECT w.tree, w.scope_key, w.n, w.a AS root, w.depth, list_reverse(w.seen) AS nodes
  FROM walk w JOIN roots r ON r.tree = w.tree AND r.scope_key = w.scope_key AND r.n = w.a
  WHERE NOT EXISTS (SELECT 1 FROM cyc c WHERE c.tree = w.tree AND c.scope_key = w.scope_key AND c.n = w.n)
  UNION ALL SELECT tree, scope_key, n, n, 0, [n] FROM roots)
SELECT tree, scope_key, n AS node_id, root AS root_id, depth AS node_depth, array_to_string(nodes, '/') AS node_path
FROM (SELECT *, row_number() OVER (PARTITION BY tree, scope_key, n, root ORDER BY depth, nodes) AS rn FROM way) x WHERE rn = 1
"""
P2_DESCENDANTS = _P2_HEAD.rstrip().rstrip(",") + """
SELECT w.tree, w.scope_key, w.a AS node_id, w.n AS descendant_id, CAST(min(w.depth) AS INTEGER) AS distance, bool_or(c.n IS NOT NULL) AS on_cycle
FROM walk w LEFT JOIN cyc c ON c.tree = w.tree AND c.scope_key = w.scope_key AND c.n = w.n GROUP BY 1, 2, 3, 4
"""

# the references themselves, not their months
_EACH = (
    P5.replace("strftime(c.snapshot_time, '%Y-%m') AS ref_month,", "c.snapshot_time AS at, 0 AS xid, 0 AS lsn, strftime(c.snapshot_time, '%Y-%m') AS ref_month,")
    .replace("strftime(l.committed_at, '%Y-%m') AS ref_month,", "l.committed_at AS at, l.xid, l.lsn, strftime(l.committed_at, '%Y-%m') AS ref_month,")
)
_I = _EACH.index("SELECT DISTINCT 'policy_snapshot_history'")
P5_REPORT = f"{_EACH[:_I]}, refs AS ({_EACH[_I:]}) SELECT source_table, ref_month, ref_status, count(*) AS n_refs FROM refs GROUP BY 1, 2, 3"

_P1_I = P1.index("SELECT tid, xid, lsn, 'renamed'")
P1_TABLE = "WITH RECURSIVE" + P1[:_P1_I].strip()[len("WITH"):] + """,
nextv AS (SELECT tid, xid, lsn, lead(xid) OVER w AS n_xid, lead(lsn) OVER w AS n_lsn FROM rec WHERE op = 'create_table' WINDOW w AS (PARTITION BY tid ORDER BY xid, lsn)),
walk AS (
  SELECT tid, xid, lsn, name, xid AS at_xid, lsn AS at_lsn, name AS at_name FROM col
  UNION ALL
  SELECT w.tid, w.xid, w.lsn, w.name, v.n_xid, v.n_lsn, s.new_name FROM walk w
  JOIN nextv v ON v.tid = w.tid AND v.xid = w.at_xid AND v.lsn = w.at_lsn
  JOIN same s ON s.tid = w.tid AND s.xid = v.n_xid AND s.lsn = v.n_lsn AND s.old_name = w.at_name),
stop AS (SELECT *, row_number() OVER (PARTITION BY tid, xid, lsn, name ORDER BY at_xid DESC, at_lsn DESC) AS rn FROM walk),
named AS (SELECT s.tid, s.xid, s.lsn, s.name, CASE WHEN v.n_xid IS NULL THEN s.at_name ELSE s.at_name || '@' || s.at_xid END AS final
  FROM stop s JOIN nextv v ON v.tid = s.tid AND v.xid = s.at_xid AND v.lsn = s.at_lsn WHERE s.rn = 1),
raw AS (SELECT DISTINCT f.tid, f.f_xid, f.v_xid, f.v_lsn, f.key, t.payload FROM table_dump t
  JOIN file f ON f.db_id = t.db_id AND f.schema_name = t.schema_name AND f.table_name = t.table_name AND f.f_xid = t.xid WHERE json_valid(t.payload) AND json_type(t.payload) = 'OBJECT'),
line_ AS (SELECT *, row_number() OVER () AS line_id FROM raw),
field AS (SELECT line_id, tid, v_xid, v_lsn, unnest(json_keys(payload)) AS name FROM line_),
cell AS (SELECT f.line_id, CASE WHEN n.final IS NOT NULL THEN n.final
      WHEN EXISTS (SELECT 1 FROM named o WHERE o.tid = f.tid AND o.xid = f.v_xid AND o.lsn = f.v_lsn AND o.final = f.name) THEN f.name || '@undeclared' ELSE f.name END AS k,
    json_extract_string(l.payload, '$."' || f.name || '"') AS v
  FROM field f JOIN line_ l ON l.line_id = f.line_id LEFT JOIN named n ON n.tid = f.tid AND n.xid = f.v_xid AND n.lsn = f.v_lsn AND n.name = f.name)
SELECT DISTINCT l.tid, l.f_xid AS file_xid, l.v_xid, l.v_lsn, json_extract_string(l.payload, '$."' || l.key || '"') AS row_key,
  coalesce((SELECT '{' || string_agg(CAST(to_json(k) AS VARCHAR) || ':' || CAST(to_json(v) AS VARCHAR), ',' ORDER BY k) || '}' FROM cell c WHERE c.line_id = l.line_id AND c.v IS NOT NULL), '{}') AS columns
FROM line_ l
"""

SQL = {"p1_found": P1, "p1_table": P1_TABLE, "p2_found": P2, "p2_paths": P2_PATHS, "p2_descendants": P2_DESCENDANTS, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p5_report": P5_REPORT}
