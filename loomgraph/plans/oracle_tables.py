"""SQL for DuckDB with the results of the queries over the code-graph tables."""

from __future__ import annotations

from loomgraph.functions.vocab import ENTRY_FILES, ENTRY_NAMES, HANDLER_AFFIXES, HANDLER_DIRS, HANDLER_STEMS, MANIFEST_LANGUAGES, SCAN_SKIP_DIRS, SCAN_SUFFIXES, SIZE_CAP, TEST_PARTS, VENDOR_DIRS
from loomgraph.plans.tables import LINE_RULES

_KEY = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ENT = """ent AS (SELECT id, repo, type, name, name_key, status, version, summary, file_path, line_start FROM entities
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, repo DESC, type DESC, name DESC, name_key DESC, status DESC, summary DESC NULLS LAST, file_path DESC NULLS LAST, line_start DESC NULLS LAST) = 1)"""
_EDGE = rf"""{_ENT}, nm AS (SELECT repo, name_key, min(id) AS dst FROM ent WHERE status <> 'deleted' GROUP BY ALL),
cls AS (SELECT class_id, repo, bases, calls FROM class_infos QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY scanned_at DESC, repo DESC, name DESC, bases DESC NULLS LAST, calls DESC NULLS LAST) = 1),
ref AS (SELECT class_id AS src, repo, 'extends' AS kind, unnest(bases) AS name FROM cls UNION ALL SELECT class_id, repo, 'calls', unnest(calls).callee_name FROM cls),
edge AS (SELECT DISTINCT src, kind, dst FROM ref JOIN nm ON nm.repo = ref.repo AND nm.name_key = {_KEY.format("ref.name")})"""
_MAN = r"""(SELECT repo || '/' || regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '') AS path, regexp_replace(lower(hash), '^sha256:', '') AS hash, size, mtime, language, entity_ids
  FROM manifest_snapshots WHERE snap_no = {n} QUALIFY row_number() OVER (PARTITION BY 1 ORDER BY delivered_at DESC, hash DESC NULLS LAST, size DESC, mtime DESC, language DESC NULLS LAST, entity_ids DESC NULLS LAST) = 1)""".replace("PARTITION BY 1", r"PARTITION BY repo || '/' || regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '')").replace("hash DESC NULLS LAST, size", "regexp_replace(lower(hash), '^sha256:', '') DESC NULLS LAST, size")
_FND = """fnd AS (SELECT id, lower(trim(pattern_id)) AS pattern_id, lower(trim(severity)) AS severity, owasp, file, coalesce(taint_reachable, false) AS reach FROM findings
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY snap_no DESC, delivered_at DESC, lower(trim(pattern_id)) DESC, lower(trim(severity)) DESC, status DESC, file DESC, line DESC) = 1)"""
_PTS = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN CASE WHEN reach THEN 9 ELSE 6 END WHEN 'medium' THEN CASE WHEN reach THEN 3 ELSE 2 END WHEN 'low' THEN CASE WHEN reach THEN 2 ELSE 1 END ELSE 0 END"
_HASH = r"'sha256:' || sha256(regexp_replace(text, '\r\n?', chr(10), 'g'))"
_FILE = r"regexp_extract(path, '([^/]*)$', 1)"
_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '.(\.[^.]+)$', 1))"
_STEM = rf"lower(regexp_replace({_FILE}, '(.)\.[^.]*$', '\1'))"
_FSTEM = _STEM.replace("path", "file")
_FPARTS = "string_split(lower(file), '/')"

ORACLES = {
    "current_entities": f"WITH {_ENT} SELECT * FROM ent",
    "entity_edges": f"WITH {_EDGE} SELECT * FROM edge",
    "code_stats": f"WITH {_ENT} SELECT type, count(*) AS n, count(*) FILTER (status = 'stub') AS n_stubs FROM ent WHERE status <> 'deleted' GROUP BY type",
    "code_hubs": f"WITH {_EDGE} SELECT dst AS id, count(*) AS n_in FROM edge WHERE kind = 'calls' GROUP BY dst HAVING count(*) >= 5",
    "code_orphans": f"""WITH {_EDGE} SELECT id, name, file_path FROM ent WHERE status NOT IN ('deleted', 'stub') AND type = 'class'
AND NOT EXISTS (SELECT 1 FROM edge JOIN ent s ON s.id = edge.src AND s.status <> 'deleted' WHERE edge.dst = ent.id)
AND lower(name) NOT IN ({_list(ENTRY_NAMES)}) AND NOT regexp_matches(name, '^__[a-z_]+__$')
AND NOT (contains(coalesce(file_path, ''), 'tests/') OR contains(coalesce(file_path, ''), '/test_') OR starts_with(coalesce(file_path, ''), 'test_'))
AND NOT regexp_matches(coalesce(file_path, ''), '(?:{"|".join(f.replace(".", "[.]") for f in ENTRY_FILES)})$') AND NOT list_has_any(string_split(coalesce(file_path, ''), '/'), [{_list(VENDOR_DIRS)}])""",
    "code_impact": f"""WITH RECURSIVE {_EDGE}, top AS (SELECT dst AS id FROM edge JOIN ent ON ent.id = dst AND ent.status <> 'deleted' GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
b AS (SELECT id, 0 AS hop FROM top UNION SELECT e.src, b.hop + 1 FROM b JOIN edge e ON e.dst = b.id WHERE b.hop < 3)
SELECT b.id, CAST(min(hop) AS INTEGER) AS hop FROM b JOIN ent ON ent.id = b.id AND ent.status <> 'deleted' GROUP BY b.id HAVING min(hop) > 0""",
    "name_index": f"WITH {_ENT} SELECT {_KEY.format('name')} AS name_key, count(DISTINCT repo) AS n_repos, count(*) AS n FROM ent WHERE status <> 'deleted' GROUP BY 1",
    "stub_matches": f"""WITH {_ENT}, act AS (SELECT {_KEY.format('name')} AS k, min(id) AS entity_id FROM ent WHERE status = 'active' GROUP BY 1),
st AS (SELECT id, name FROM ent WHERE status = 'stub' UNION ALL SELECT 'stub of ' || id, 'pkg.' || name FROM ent WHERE status = 'active'),
w AS (SELECT id, 0 AS tier, replace(name, '.', '/') || '.py' AS w FROM st WHERE contains(name, '.') AND NOT contains(name, '/') UNION ALL SELECT id, 1, name FROM st
UNION ALL SELECT id, 2, string_split(name, '.')[-1] FROM st WHERE len(string_split(name, '.')) = 2 AND regexp_matches(string_split(name, '.')[-1], '^[A-Z]'))
SELECT w.id AS stub_id, min_by(act.entity_id, tier) AS entity_id FROM w JOIN act ON act.k = {_KEY.format('w.w')} GROUP BY w.id""",
    "rewired_edges": f"""WITH {_EDGE}, st AS (SELECT stub_id, max_by(entity_id, (resolved_at, entity_id)) AS entity_id FROM stub_resolutions WHERE entity_id IS NOT NULL GROUP BY stub_id)
SELECT DISTINCT src, kind, coalesce(entity_id, dst) AS dst FROM edge LEFT JOIN st ON st.stub_id = dst WHERE src <> coalesce(entity_id, dst)""",
    "unused_stubs": f"WITH {_EDGE} SELECT id FROM ent WHERE status = 'stub' AND NOT EXISTS (SELECT 1 FROM edge JOIN ent s ON s.id = edge.src AND s.status = 'active' WHERE edge.dst = ent.id)",
    "manifest_delta": f"""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
WHEN NOT coalesce(o.size > 0 AND o.mtime > 0 AND n.size = o.size AND n.mtime = o.mtime, false) AND coalesce(n.hash, '') <> '' AND coalesce(o.hash, '') <> '' AND n.hash <> o.hash THEN 'modified' ELSE 'unchanged' END AS change
FROM {_MAN.format(n=2)} n FULL JOIN {_MAN.format(n=1)} o ON n.path = o.path""",
    "manifest_stats": f"SELECT language, count(*) AS n_files, CAST(sum(coalesce(len(entity_ids), 0)) AS BIGINT) AS n_entities FROM {_MAN.format(n=8)} GROUP BY language",
    "retired_entities": f"SELECT DISTINCT path, unnest(entity_ids) AS id FROM {_MAN.format(n=7)} o WHERE NOT EXISTS (SELECT 1 FROM {_MAN.format(n=8)} n WHERE n.path = o.path)".replace("SELECT DISTINCT path, unnest(entity_ids) AS id", "SELECT DISTINCT path, id FROM (SELECT path, unnest(entity_ids) AS id") + ") WHERE id IS NOT NULL",
    "removed_children": """WITH cur AS (SELECT module_entity_id AS parent, class_entity_ids FROM ingest_results QUALIFY row_number() OVER (PARTITION BY module_entity_id ORDER BY ingested_at DESC, class_entity_ids DESC NULLS LAST, path DESC) = 1),
now AS (SELECT parent, unnest(class_entity_ids) AS id FROM cur), ever AS (SELECT DISTINCT module_entity_id AS parent, unnest(class_entity_ids) AS id FROM ingest_results)
SELECT parent, id FROM ever WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM now WHERE now.parent = ever.parent AND now.id = ever.id)""",
    "upserted_entities": f"""WITH {_ENT}, k AS (SELECT {_KEY.format('name')} AS name_key, name, type, coalesce(file_path, '') AS fp, coalesce(line_start, 0) AS ls FROM ent WHERE status <> 'deleted'),
base AS (SELECT name_key, min(name) AS name FROM k WHERE type = 'module' GROUP BY name_key), one AS (SELECT name_key, min_by(name, (fp, ls, name)) AS name FROM k WHERE name_key <> '' GROUP BY name_key)
SELECT 'ws_' || substr(sha256(coalesce(b.name_key, o.name_key)), 1, 16) AS id, coalesce(b.name_key, o.name_key) AS name_key, CASE WHEN b.name_key IS NULL THEN 1 WHEN o.name_key IS NULL THEN 1 ELSE 2 END AS version FROM base b FULL JOIN one o ON b.name_key = o.name_key""",
    "severity_counts": f"WITH {_FND} SELECT severity, count(*) AS n, count(*) FILTER (reach) AS n_reachable FROM fnd GROUP BY severity",
    "owasp_counts": f"WITH {_FND} SELECT split_part(owasp, ':', 1) AS category, count(*) AS n FROM fnd GROUP BY 1",
    "file_risk": f"WITH {_FND} SELECT file, CAST(sum({_PTS}) AS BIGINT) AS risk, count(*) AS n, array_to_string(list_sort(list(DISTINCT severity)), ',') AS severities FROM fnd GROUP BY file ORDER BY risk DESC, file LIMIT 5",
    "risk_level": f"WITH {_FND} SELECT coalesce(['critical', 'high', 'medium', 'low'][min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END)], 'none') AS level FROM fnd",
    "finding_ids": "SELECT DISTINCT file, lower(trim(pattern_id)) AS pattern_id, substr(sha256(file || ':' || lower(trim(pattern_id)) || ':' || substr(trim(snippet), 1, 120)), 1, 8) AS stable_id FROM findings",
    "finding_paths": f"""WITH f AS (SELECT DISTINCT file FROM findings), s AS (SELECT file, {_FSTEM} AS stem, {_FPARTS} AS parts FROM f)
SELECT list_has_any(parts, [{_list(TEST_PARTS)}]) OR regexp_matches(stem, '[.]test|[.]spec|_test|_spec') AS is_test,
list_has_any(parts[:-2], [{_list(HANDLER_DIRS)}]) OR stem IN ({_list(HANDLER_STEMS)}) OR regexp_matches(stem, '^(?:{"|".join(HANDLER_AFFIXES)})|(?:{"|".join(HANDLER_AFFIXES)})$') AS is_handler, count(*) AS n FROM s GROUP BY 1, 2""",
    "triage_carry": """WITH p AS (SELECT snap_no, id, CASE status WHEN 'fixed' THEN 'resolved' WHEN 'accepted' THEN 'verified_vulnerability' ELSE status END AS status FROM findings WHERE snap_no IN (7, 8)
QUALIFY row_number() OVER (PARTITION BY snap_no, id ORDER BY delivered_at DESC, CASE status WHEN 'fixed' THEN 'resolved' WHEN 'accepted' THEN 'verified_vulnerability' ELSE status END DESC) = 1),
o AS (SELECT * FROM p WHERE snap_no = 7), n AS (SELECT * FROM p WHERE snap_no = 8)
SELECT n.id, CASE WHEN o.status IS NULL OR o.status = 'resolved' THEN 'unreviewed' ELSE o.status END AS status FROM n LEFT JOIN o USING (id)
UNION ALL SELECT id, 'resolved' FROM o WHERE status NOT IN ('unreviewed', 'resolved') AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = o.id)""",
    "line_hits": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
    + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE regexp_matches(line, '{v}') HAVING count(*) > 0" for k, v in LINE_RULES.items()),
    "docs_by_lang": f"SELECT coalesce(nullif(lang, ''), CASE {_EXT} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MANIFEST_LANGUAGES.items())} ELSE '' END) AS language, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "doc_hashes": f"SELECT doc_id, {_HASH} AS hash FROM documents",
    "duplicate_docs": f"SELECT {_HASH} AS hash, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "skip_reasons": r"""SELECT CASE WHEN length(text) > 100 AND length(text) - length(replace(text, chr(0), '')) > length(text) * 0.1 THEN 'binary' WHEN length(text) > 10000 AND length(text) - length(replace(text, chr(10), '')) < 5 THEN 'minified'
WHEN regexp_matches(coalesce(text, ''), '^[\s\p{Z}\x0b\x1c-\x1f\x85]*$') THEN 'empty' ELSE 'none' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "preview": f"SELECT {_EXT} AS ext, count(*) AS n, {_EXT} IN ({_list(SCAN_SUFFIXES)}) AS supported FROM documents GROUP BY 1, 3 ORDER BY n DESC, ext LIMIT 10",
    "path_stems": f"SELECT doc_id, {_STEM} AS stem, {_EXT} AS ext FROM documents",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""",
    "scan_candidates": f"""SELECT {_EXT} AS ext, count(*) AS n FROM documents WHERE {_EXT} IN ({_list(SCAN_SUFFIXES)}) AND length(text) <= {SIZE_CAP} AND NOT contains(path, 'node_modules')
AND NOT list_has_any(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), [{_list(SCAN_SKIP_DIRS)}]) AND len(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda x: starts_with(x, '.') AND length(x) > 1)) = 0 GROUP BY 1""",
}
