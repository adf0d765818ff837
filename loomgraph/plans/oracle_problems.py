"""SQL for DuckDB with the results of the general pN_ queries."""

_NAME_KEY = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"

P1 = r"""
WITH m AS (
  SELECT 'manifest_snapshots' AS src, repo, snap_no, delivered_at,
    regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '') AS rec_key,
    nullif(regexp_replace(lower(trim(hash)), '^sha256:', ''), '') AS a,
    CAST(size AS VARCHAR) AS b, CAST(mtime AS VARCHAR) AS c FROM manifest_snapshots
  UNION ALL
  SELECT 'findings', repo, snap_no, delivered_at, id, lower(trim(pattern_id)), lower(trim(severity)), status FROM findings
), r AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY src, repo, snap_no, rec_key ORDER BY delivered_at DESC, a DESC NULLS LAST, b DESC NULLS LAST, c DESC NULLS LAST) = 1
), p AS (
  SELECT repo, snap_no, lag(snap_no) OVER (PARTITION BY repo ORDER BY snap_no) AS old_no FROM (SELECT DISTINCT repo, snap_no FROM snapshot_log)
), n AS (SELECT r.src, r.repo, p.snap_no, r.rec_key, r.a, r.b, r.c FROM r JOIN p USING (repo, snap_no) WHERE p.old_no IS NOT NULL),
o AS (SELECT r.src, r.repo, p.snap_no, r.rec_key, r.a, r.b, r.c FROM r JOIN p ON r.repo = p.repo AND r.snap_no = p.old_no),
j AS (
  SELECT coalesce(n.src, o.src) AS src, coalesce(n.repo, o.repo) AS repo, coalesce(n.snap_no, o.snap_no) AS snap_no, coalesce(n.rec_key, o.rec_key) AS rec_key,
    CASE WHEN o.src IS NULL THEN 'new' WHEN n.src IS NULL THEN 'deleted'
      WHEN n.src = 'findings' AND (n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b OR n.c IS DISTINCT FROM o.c) THEN 'modified'
      WHEN n.src <> 'findings' AND CASE WHEN n.a IS NULL OR o.a IS NULL THEN n.b IS DISTINCT FROM o.b OR n.c IS DISTINCT FROM o.c ELSE n.a <> o.a END THEN 'modified' END AS change
  FROM n FULL JOIN o ON n.src = o.src AND n.repo = o.repo AND n.snap_no = o.snap_no AND n.rec_key = o.rec_key
)
SELECT * FROM j WHERE change IS NOT NULL
"""

P2 = rf"""
WITH RECURSIVE box AS (
  SELECT module_entity_id, class_entity_ids FROM ingest_results WHERE module_entity_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY module_entity_id ORDER BY ingested_at DESC, class_entity_ids DESC NULLS LAST) = 1
), cls AS (
  SELECT class_id, repo, {_NAME_KEY.format("name")} AS own, {_NAME_KEY.format("bases[1]")} AS base FROM class_infos WHERE class_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY scanned_at DESC, repo DESC, name DESC, bases DESC NULLS LAST) = 1
), link AS (
  SELECT 'contains' AS forest, module_entity_id AS id, NULL AS parent FROM box
  UNION ALL SELECT 'contains', x, module_entity_id FROM (SELECT unnest(class_entity_ids) AS x, module_entity_id FROM box) WHERE x IS NOT NULL
  UNION ALL SELECT 'extends', c.class_id, b.class_id FROM cls c LEFT JOIN cls b ON b.repo = c.repo AND b.own = c.base
), node AS (SELECT forest, id, min(parent) AS parent FROM link GROUP BY ALL),
tree AS (
  SELECT forest, id, id AS root, 0 AS depth, id AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT n.forest, n.id, t.root, t.depth + 1, t.path || '/' || n.id FROM node n JOIN tree t ON n.forest = t.forest AND n.parent = t.id
), anc AS (
  SELECT forest, id, unnest(string_split(path, '/')) AS up FROM tree
), descs AS (SELECT forest, up AS id, count(*) - 1 AS n FROM anc GROUP BY ALL),
walk AS (
  SELECT forest, id AS start, parent AS spot FROM node n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.forest = n.forest AND t.id = n.id)
  UNION SELECT w.forest, w.start, n.parent FROM walk w JOIN node n ON n.forest = w.forest AND n.id = w.spot
)
SELECT t.forest, t.id AS node_id, 'tree' AS state, t.root AS root_id, t.depth, CAST(d.n AS INTEGER) AS n_desc, t.path AS node_path
FROM tree t JOIN descs d ON d.forest = t.forest AND d.id = t.id
UNION ALL
SELECT forest, start, CASE WHEN bool_or(start = spot) THEN 'cycle' ELSE 'below_cycle' END, '', -1, -1, '' FROM walk GROUP BY forest, start
"""

_P3 = rf"""
WITH ent AS (
  SELECT id, repo, name_key, status, created FROM entities WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, repo DESC, name_key DESC, status DESC, created DESC) = 1
), ref AS (
  SELECT 'class_infos' AS src_table, class_id AS ref_key, repo, 'bases' AS field, unnest(bases) AS name, scanned_at AS seen_at FROM class_infos
  UNION ALL SELECT 'class_infos', class_id, repo, 'calls', unnest(calls).callee_name, scanned_at FROM class_infos
), named AS (
  SELECT src_table, ref_key, repo, field, {_NAME_KEY.format("name")} AS target, seen_at FROM ref WHERE name IS NOT NULL
), hit AS (
  SELECT n.*, e.id AS hit, e.status, e.created FROM named n LEFT JOIN ent e ON e.repo = n.repo AND e.name_key = n.target
  UNION ALL
  SELECT 'stub_resolutions', s.stub_id, s.repo, 'entity_id', s.entity_id, s.resolved_at, e.id, e.status, e.created
  FROM stub_resolutions s LEFT JOIN ent e ON e.id = s.entity_id WHERE s.entity_id IS NOT NULL
), bad AS (
  SELECT *, strftime(seen_at, '%Y-%m') AS period, CASE WHEN hit IS NULL THEN 'missing' WHEN status = 'deleted' THEN 'deleted' WHEN created > seen_at THEN 'late' END AS reason FROM hit
)
"""

P3 = _P3 + "SELECT DISTINCT src_table, ref_key, field, target, period, reason FROM bad WHERE reason IS NOT NULL"
P3_REPORT = _P3 + """
SELECT src_table, period, count(*) AS n_refs, count(reason) AS n_orphans, count(reason) / count(*) AS rate FROM bad GROUP BY src_table, period
"""

P3_PARTIAL = """
WITH ent AS (
  SELECT id, repo, status, created FROM entities WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, repo DESC, status DESC, created DESC) = 1
), ref AS (SELECT module_entity_id AS ref_key, repo, unnest(class_entity_ids) AS target, ingested_at AS seen_at FROM ingest_results),
one AS (SELECT repo, id, status = 'deleted' AS gone, created FROM ent),
anyone AS (SELECT repo, bool_and(status = 'deleted') AS gone, min(created) FILTER (status <> 'deleted') AS created FROM ent WHERE repo IS NOT NULL GROUP BY repo),
judged AS (
  SELECT r.*, o.id IS NULL AS absent, o.gone, o.created FROM ref r LEFT JOIN one o ON o.repo = r.repo AND o.id = r.target WHERE r.repo IS NOT NULL AND r.target IS NOT NULL
  UNION ALL SELECT r.*, s.repo IS NULL, s.gone, s.created FROM ref r LEFT JOIN anyone s ON s.repo = r.repo WHERE r.repo IS NOT NULL AND r.target IS NULL
  UNION ALL SELECT r.*, o.id IS NULL, o.gone, o.created FROM ref r LEFT JOIN one o ON o.id = r.target WHERE r.repo IS NULL AND r.target IS NOT NULL
)
SELECT DISTINCT ref_key, repo, target, CASE WHEN absent THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS reason FROM judged WHERE absent OR gone OR created > seen_at
"""

P7 = """
WITH run AS (
  SELECT min(run_id) AS run_id, cutoff_at FROM scan_runs WHERE status = 'done' AND cutoff_at IS NOT NULL GROUP BY cutoff_at
), held_at AS (
  SELECT r.run_id, r.cutoff_at, f.repo, f.path, max_by(f.hash, (f.last_scanned, f.status_id)) AS h
  FROM run r JOIN file_status f ON f.arrived_at <= r.cutoff_at AND f.hash <> '' GROUP BY ALL
), d AS (SELECT *, lag(h) OVER (PARTITION BY repo, path ORDER BY cutoff_at) AS before FROM held_at)
SELECT run_id, repo, path FROM d WHERE before IS DISTINCT FROM h
"""

ORACLES = {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_report": P3_REPORT, "p3_partial": P3_PARTIAL, "p7_found": P7}
