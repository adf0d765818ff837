"""Queries of lookups, merges, reviews and stores over the test tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.text import factory_class, is_exception_name, module_path, name_key
from loomgraph.functions.vocab import SCAN_SUFFIXES, SEVERITY_RANK, TEST_PARTS
from loomgraph.operators import graph, maintain, search, security
from loomgraph.plans import star
from loomgraph.plans.oracle_tables import _ENT, _FND, _FPARTS, _FSTEM, _KEY, _MAN, _list
from loomgraph.plans.tables import NOW, _findings, _latest, _manifest, current_entities
from loomgraph.session import scratch_path, stage, table
from loomgraph.sources.store import GraphStore

def _at():
    return F.lit(NOW).cast("timestamp")


def _callers_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current classes as entities: the methods that call are the ones they define, a call names its class and the method it is made in."""
    c = table(spark, sf_dir, "class_infos").select("class_id", "name", "calls", "scanned_at", "line_start", "file_path")
    c = _latest(c, ["class_id"], ["scanned_at", "name", "calls", "line_start", "file_path"])
    each = F.filter(F.coalesce("calls", F.array().cast(dict(c.dtypes)["calls"])), lambda x: x["via_method"].isNotNull() & x["callee_name"].isNotNull())
    entities = schema.conform(
        c.select(
            F.col("class_id").alias("id"), F.lit(0).alias("seq"), F.lit("class").alias("type"), "name", name_key(F.col("name")).alias("name_key"), F.lit("active").alias("status"), "line_start", "file_path",
            F.array_distinct(F.transform(each, lambda x: x["via_method"])).alias("methods"),
            F.transform(each, lambda x: F.struct(name_key(x["callee_name"]).alias("receiver"), x["via_method"].alias("method"), x["via_method"].alias("via"))).alias("called_methods"),
        ),
        schema.ENTITIES,
    )
    entities = stage(entities, "classes")
    first = entities.filter("name_key != ''").groupBy("name_key").agg(F.min("id").alias("dst"))
    edges = entities.select(F.col("id").alias("src"), F.explode("called_methods").alias("c")).select("src", F.col("c.receiver").alias("name_key")).join(first, "name_key").select("src", F.lit("calls").alias("kind"), "dst").distinct()
    return entities, schema.conform(edges.withColumn("pos", F.lit(0)), schema.EDGES)


def _method(entities: DataFrame) -> str:
    """The method name that most classes define."""
    row = entities.select(F.explode("methods").alias("m")).groupBy(F.lower("m").alias("m")).count().orderBy(F.desc("count"), "m").first()
    return row["m"] if row else ""


def method_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, _ = _callers_graph(spark, sf_dir)
    return search.method_definitions(entities, _method(entities)).select("id", "priority")


def method_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls the most frequent method on which class."""
    entities, edges = _callers_graph(spark, sf_dir)
    m = _method(entities)
    return search.method_callers(entities, edges, search.method_definitions(entities, m).select("id"), m).select("class_id", "id").distinct()


def searched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live classes of a kind."""
    e = table(spark, sf_dir, "entities").select("id", "type", "status", "version", "kind")
    e = _latest(e, ["id"], ["version", "type", "status", "kind"])
    return search.search(e, type="class", kind="abstract").select("id")


def stub_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stub_names(current_entities(spark, sf_dir))


def context_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers for a text, with the nations they depend on; orders are no neighbours at this level of detail."""
    n = star.nodes(spark, sf_dir).withColumn("type", F.when(F.col("type") == "supplier", "class").when(F.col("type") == "nation", "package").otherwise("other"))
    n = n.filter("type in ('class', 'package')")
    return search.context(n, star.edges(spark, sf_dir), "supplier 000000007", max_seeds=6, hops=1, detail="high", max_results=40)


def orphan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred customers whom no urgent order calls, with their total."""
    return graph.orphan_page(star.orphan_customers(spark, sf_dir).withColumn("type", F.lit("customer"))).select("id", "total")


def retired_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of files that the last snapshot no longer has, retired: status and version of every entity."""
    gone = maintain.retired_files(_manifest(spark, sf_dir, 7), _manifest(spark, sf_dir, 8)).filter("id is not null").select("id")
    e = current_entities(spark, sf_dir).withColumn("updated", F.lit(NOW).cast("timestamp"))
    return maintain.retire(e, gone, _at(), "file removed").select("id", "status", "version")


def rescan_keeps_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First versions with contributed facts, after a scan that finds the current rows: versions, states and facts."""
    rows = table(spark, sf_dir, "entities").select("id", "type", "name", "name_key", "status", "version", "summary", "file_path", "line_start")
    first = rows.filter("status != 'deleted'").groupBy("id").agg(F.min(F.struct("version", "type", "name", "name_key", "status", "summary", "file_path", "line_start")).alias("f")).select("id", "f.*")
    before = schema.conform(first.withColumns({"source": F.lit("scanner"), "custom": F.create_map(F.lit("owner"), F.col("id"), F.lit("language"), F.lit("old")), "version": F.lit(1), "created": _at()}), schema.ENTITIES)
    now = current_entities(spark, sf_dir).filter("status = 'active'").drop("repo")
    found = schema.conform(now.withColumns({"source": F.lit("scanner"), "custom": F.create_map(F.lit("language"), F.lit("new")), "version": F.lit(1), "created": _at(), "updated": _at()}), schema.ENTITIES)
    merged = maintain.merge_scan(before, found, _at())
    return merged.select("id", "status", "version", F.col("custom")["owner"].alias("owner"), F.col("custom")["language"].alias("language"), F.size(F.coalesce("timeline", F.array().cast(dict(merged.dtypes)["timeline"]))).alias("n_events"))


def contributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that contribute a relation to their region and one to something unknown: relations and stubs."""
    n = star.nodes(spark, sf_dir).filter("type in ('nation', 'region')")
    e = schema.conform(n.withColumn("version", F.lit(1)), schema.ENTITIES)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    notes = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("entity_name"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")).alias("properties"),
        F.array(*[F.struct(t.alias("target"), F.lit(k).alias("kind"), F.lit(None).cast("string").alias("note")) for t, k in ((F.col("r_name"), "related_to"), (F.concat(F.lit("Ministry of "), "n_name"), "uses"), (F.lit(""), "uses"))]).alias("relations"),
        F.lit("told").alias("rationale"), F.lit("agent").alias("source"),
    )
    entities, edges = maintain.contribute(e, schema.empty(spark, schema.EDGES), notes, _at())
    entities = entities.select("id", "status", "version", F.col("custom")["key"].alias("fact"))
    return edges.join(entities.withColumnRenamed("id", "src"), "src").select("src", "kind", "dst", "version", "fact").join(entities.select(F.col("id").alias("dst"), F.col("status").alias("dst_status")), "dst")


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after all of the files below ``src`` were triaged, by status."""
    f = table(spark, sf_dir, "findings").select("id", "file", "status", "notes", "snap_no", "delivered_at")
    f = _latest(f, ["id"], ["snap_no", "delivered_at", "status", "file", "notes"])
    return security.triage(f, "false_positive", file="SRC/", notes="reviewed").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("notes") == "reviewed").alias("n_reviewed"))


def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst findings of the injection category, as shown."""
    f = _findings(spark, sf_dir).withColumn("language", F.lit(""))
    return security.display(f, severity="high", owasp="A03", max_results=200).select("id", "severity", "file")


def severity_in_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity after those of test files count one level less."""
    f = _findings(spark, sf_dir)
    return f.select(F.coalesce(security.severity_in(F.col("severity"), F.col("file")), F.lit("none")).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of findings against the one before."""
    f = table(spark, sf_dir, "findings").select("id", "snap_no", "file", "status", "taint_reachable", "delivered_at")
    pick = lambda n: _latest(f.filter(F.col("snap_no") == n).drop("snap_no"), ["id"], ["delivered_at", "status", "file", "taint_reachable"])
    return security.summary(pick(8), pick(7))


def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the entity that most files have."""
    m = _manifest(spark, sf_dir, 8)
    top = m.select(F.explode("entity_ids").alias("id")).filter("id is not null").groupBy("id").count().orderBy(F.desc("count"), "id").first()
    return maintain.files_of_entity(m, top["id"] if top else "")


def manifest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.manifest_rows(_manifest(spark, sf_dir, 8), "lattice-core-main/").select("path", "size")


def manifest_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first manifest with the rows of the second recorded over it."""
    return maintain.record_files(_manifest(spark, sf_dir, 1), _manifest(spark, sf_dir, 2)).select("path", "size", "language")


def manifest_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last manifest without deleted entities: paths that stay, with how many entities."""
    gone = current_entities(spark, sf_dir).filter("status = 'deleted'").select("id")
    return maintain.forget_entities(_manifest(spark, sf_dir, 8), gone).select("path", F.size(F.array_distinct(F.filter(F.coalesce("entity_ids", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("n"))


def manifest_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows from the entities that say which file they come from."""
    e = current_entities(spark, sf_dir).filter("file_path is not null").select("id", "status", F.array(F.struct(F.concat_ws("/", "repo", "file_path").alias("path"), F.lit("").alias("hash"), F.lit("").alias("language"), F.lit(0).cast("bigint").alias("size"))).alias("source_files"))
    return maintain.rebuild_manifest(e).select("path", F.size("entity_ids").alias("n"))


def exception_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entities, and of what classes extend, that name exceptions."""
    bases = table(spark, sf_dir, "class_infos").select(F.explode("bases").alias("name"))
    names = current_entities(spark, sf_dir).select("name").union(bases).union(table(spark, sf_dir, "subject_areas").select(F.concat("subject", F.lit("Error")))).filter("name is not null").distinct()
    return names.groupBy(is_exception_name(F.col("name")).alias("is_exception")).agg(F.count(F.lit(1)).alias("n"))


def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("path is not null").select("doc_id", module_path(F.col("path")).alias("module"))


def factory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that functions make, by the functions' names."""
    n = current_entities(spark, sf_dir).select(F.regexp_replace(F.lower(F.concat(F.lit("make_"), "name")), "[^a-z0-9]+", "_").alias("name")).distinct()
    return n.select("name", factory_class(F.col("name")).alias("made"))


def entity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with current entities without a source for stubs, a known state for functions and a version for the deleted, each error with its count."""
    e = table(spark, sf_dir, "entities").select("id", "type", "name", "status", "source", "version", "kind")
    e = _latest(e, ["id"], ["version", "type", "name", "status", "source", "kind"])
    e = e.select("id", "type", "name", F.when(F.col("type") == "function", "odd").otherwise(F.col("status")).alias("status"), F.when(F.col("status") != "stub", F.col("source")).alias("source"), F.when(F.col("status") == "deleted", 0).otherwise(F.col("version")).alias("version"), F.concat(F.coalesce("kind", F.array().cast("array<string>")), F.when(F.col("type") == "module", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))).alias("kind"))
    return schema.validation_errors(e).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def hard_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left by type after those marked deleted are removed for good."""
    e = current_entities(spark, sf_dir)
    left, _ = maintain.delete(e, schema.empty(spark, schema.EDGES), e.filter("status = 'deleted'").select("id"), _at(), hard=True)
    return left.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def purged_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = current_entities(spark, sf_dir).withColumn("updated", _at())
    return maintain.purge_stubs(e, _at()).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


def updated_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region renamed and given facts and tags; the other regions stay."""
    e = schema.conform(star.nodes(spark, sf_dir).filter("type = 'region'").withColumn("version", F.lit(1)), schema.ENTITIES)
    out = maintain.update(e, "R:0", {"name": "The South", "summary": "renamed"}, _at(), sections={"custom": {"a": 1}, "tags": ["x", "y", "x"]})
    return out.select("id", "name", "name_key", "version", "summary", F.col("custom")["a"].alias("fact"), F.array_join("tags", ",").alias("tags"))


def stored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current entities published to a store, stubs patched, and read back."""
    e = schema.conform(current_entities(spark, sf_dir), schema.ENTITIES)
    store = GraphStore(spark, scratch_path(spark, "store"))
    store.publish({"entities": e})
    store.publish({}, patches={"entities": store.load("entities").filter("status = 'stub'").withColumn("version", F.col("version") + 100)})
    return store.load("entities").select("id", "status", "version")


def impact_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependents of a nation, grouped for display by hop."""
    return star.neighborhood_nation(spark, sf_dir).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_estimate(current_entities(spark, sf_dir).filter("status != 'deleted'"))


QUERIES = {
    f.__name__: f
    for f in (
        method_definitions, method_callers, searched_entities, stub_names, context_suppliers, orphan_page, retired_status, rescan_keeps_facts, contributed, triaged, displayed, severity_in_tests, finding_summary, entity_files,
        manifest_prefix, manifest_recorded, manifest_forgotten, manifest_rebuilt, exception_names, module_paths, factory_names, entity_errors, hard_deleted, purged_stubs, updated_entity, stored_entities, impact_by_hop, context_tokens,
    )
}

_CLS = rf"""cls AS (SELECT class_id AS id, name, list_filter(coalesce(calls, []), lambda x: x.via_method IS NOT NULL AND x.callee_name IS NOT NULL) AS calls FROM class_infos
  QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY scanned_at DESC, name DESC, calls DESC NULLS LAST) = 1),
call AS (SELECT id, {_KEY.format("c.callee_name")} AS receiver, c.via_method AS m FROM (SELECT id, unnest(calls) AS c FROM cls)),
top AS (SELECT lower(m) AS m FROM (SELECT DISTINCT id, m FROM call) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
def AS (SELECT DISTINCT call.id FROM call JOIN top ON lower(call.m) = top.m)"""
_RANK = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " ELSE 9 END"
_FND_ALL = _FND.replace("SELECT id,", "SELECT id, line, status,")
_KNOWN = "|".join(s[1:] for s in SCAN_SUFFIXES)

ORACLES = {
    "method_definitions": f"WITH {_CLS} SELECT id, 1 AS priority FROM def",
    "method_callers": rf"""WITH {_CLS}, nm AS (SELECT {_KEY.format("name")} AS k, min(id) AS dst FROM cls WHERE {_KEY.format("name")} <> '' GROUP BY 1),
edge AS (SELECT DISTINCT call.id AS src, nm.dst FROM call JOIN nm ON nm.k = call.receiver), t AS (SELECT DISTINCT call.id, receiver FROM call JOIN top ON lower(call.m) = top.m),
named AS (SELECT DISTINCT def.id AS class_id, t.id FROM t JOIN cls ON lower(cls.name) = t.receiver JOIN def ON def.id = cls.id WHERE t.receiver <> '' AND t.id <> def.id
UNION SELECT def.id, t.id FROM t JOIN edge ON edge.src = t.id JOIN def ON def.id = edge.dst WHERE t.receiver <> '' AND t.id <> def.id)
SELECT class_id, id FROM named UNION SELECT NULL, id FROM t WHERE receiver = '' AND ((SELECT count(*) FROM def) > 1 OR id NOT IN (SELECT id FROM def))""",
    "searched_entities": "WITH c AS (SELECT id, type, status, kind FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, type DESC, status DESC, kind DESC NULLS LAST) = 1) SELECT id FROM c WHERE status <> 'deleted' AND type = 'class' AND list_contains(kind, 'abstract')",
    "stub_names": f"WITH {_ENT} SELECT id, name, {_KEY.format('name')} AS name_key FROM ent WHERE status = 'stub'",
    "context_suppliers": """WITH s AS (SELECT 'S:' || s_suppkey AS id, s_nationkey, CAST(s_suppkey AS BIGINT) AS seq, CASE WHEN contains(lower(s_name), 'supplier') THEN 14 ELSE 0 END + CASE WHEN lower(s_name) = '000000007' THEN 20 WHEN contains(lower(s_name), '000000007') THEN 14 ELSE 0 END AS score FROM supplier),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, seq, id LIMIT 6)
SELECT id, 0 AS hop, score FROM t UNION ALL SELECT DISTINCT 'N:' || s_nationkey, 1, 2 FROM t""",
    "orphan_page": "WITH o AS (SELECT 'C:' || c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) SELECT id, count(*) OVER () AS total FROM o ORDER BY name, id LIMIT 100",
    "retired_status": f"""WITH {_ENT}, gone AS (SELECT DISTINCT id FROM (SELECT unnest(entity_ids) AS id FROM {_MAN.format(n=7)} o WHERE NOT EXISTS (SELECT 1 FROM {_MAN.format(n=8)} n WHERE n.path = o.path)))
SELECT id, CASE WHEN id IN (SELECT id FROM gone WHERE id IS NOT NULL) THEN 'deleted' ELSE status END AS status, CASE WHEN status <> 'deleted' AND id IN (SELECT id FROM gone WHERE id IS NOT NULL) THEN version + 1 ELSE version END AS version FROM ent""",
    "rescan_keeps_facts": f"""WITH {_ENT}, b AS (SELECT id, type, name, name_key, status, summary, file_path, line_start FROM entities WHERE status <> 'deleted'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY version, type, name, name_key, status, summary NULLS FIRST, file_path NULLS FIRST, line_start NULLS FIRST) = 1),
f AS (SELECT * FROM ent WHERE status = 'active')
SELECT coalesce(b.id, f.id) AS id, CASE WHEN f.id IS NOT NULL THEN f.status WHEN b.status = 'active' THEN 'deleted' ELSE b.status END AS status,
CASE WHEN b.id IS NULL THEN 1 WHEN f.id IS NULL THEN CASE WHEN b.status = 'active' THEN 2 ELSE 1 END
WHEN (b.type, b.name, b.name_key, b.status, b.summary, b.file_path, b.line_start) IS DISTINCT FROM (f.type, f.name, f.name_key, f.status, f.summary, f.file_path, f.line_start) THEN 2 ELSE 1 END AS version,
b.id AS owner, CASE WHEN f.id IS NULL THEN 'old' ELSE 'new' END AS language, CASE WHEN f.id IS NULL AND b.status = 'active' THEN 1 ELSE 0 END AS n_events FROM b FULL JOIN f ON b.id = f.id""",
    "contributed": """SELECT 'N:' || n_nationkey AS src, 'related_to' AS kind, 'R:' || n_regionkey AS dst, 2 AS version, CAST(n_nationkey AS VARCHAR) AS fact, 'active' AS dst_status FROM nation
UNION ALL SELECT 'N:' || n_nationkey, 'uses', 'ws_' || substr(sha256(lower('Ministry of ' || n_name)), 1, 16), 2, CAST(n_nationkey AS VARCHAR), 'stub' FROM nation""",
    "triaged": """WITH f AS (SELECT id, file, status, notes FROM findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY snap_no DESC, delivered_at DESC, status DESC, file DESC, notes DESC NULLS LAST) = 1)
SELECT CASE WHEN contains(lower(file), 'src/') THEN 'false_positive' ELSE status END AS status, count(*) AS n, count(*) FILTER (contains(lower(file), 'src/') OR notes = 'reviewed') AS n_reviewed FROM f GROUP BY 1""",
    "displayed": f"WITH {_FND_ALL} SELECT id, severity, file FROM fnd WHERE {_RANK} <= {SEVERITY_RANK['high']} AND contains(owasp, 'A03') AND (status IS NULL OR status <> 'false_positive') ORDER BY {_RANK}, file, line, id LIMIT 200",
    "severity_in_tests": f"""WITH {_FND}, s AS (SELECT severity, list_has_any({_FPARTS}, [{_list(TEST_PARTS)}]) OR regexp_matches({_FSTEM}, '[.]test|[.]spec|_test|_spec') AS t FROM fnd)
SELECT coalesce(CASE WHEN NOT t THEN severity WHEN severity = 'critical' THEN 'high' WHEN severity = 'high' THEN 'medium' END, 'none') AS severity, count(*) AS n FROM s GROUP BY 1""",
    "finding_summary": """WITH p AS (SELECT snap_no, id, file, status, coalesce(taint_reachable, false) AS reach FROM findings WHERE snap_no IN (7, 8)
QUALIFY row_number() OVER (PARTITION BY snap_no, id ORDER BY delivered_at DESC, status DESC, file DESC, taint_reachable DESC NULLS LAST) = 1), o AS (SELECT * FROM p WHERE snap_no = 7), n AS (SELECT * FROM p WHERE snap_no = 8)
SELECT count(*) AS n, count(DISTINCT file) AS n_files, count(*) FILTER (reach) AS n_reachable, count(*) FILTER (status = 'false_positive') AS n_false,
(SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM o)) AS n_new, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM n)) AS n_gone FROM n""",
    "entity_files": f"WITH m AS (SELECT * FROM {_MAN.format(n=8)}), top AS (SELECT id FROM (SELECT unnest(entity_ids) AS id FROM m) WHERE id IS NOT NULL GROUP BY id ORDER BY count(*) DESC, id LIMIT 1) SELECT path FROM m, top WHERE list_contains(entity_ids, top.id)",
    "manifest_prefix": f"SELECT path, size FROM {_MAN.format(n=8)} WHERE starts_with(path, 'lattice-core-main/')",
    "manifest_recorded": f"WITH a AS (SELECT path, size, language FROM {_MAN.format(n=1)}), b AS (SELECT path, size, language FROM {_MAN.format(n=2)}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)",
    "manifest_forgotten": f"""WITH {_ENT}, m AS (SELECT path, list_filter(coalesce(entity_ids, []), lambda x: x IS NOT NULL) AS ids, coalesce(len(entity_ids), 0) AS had FROM {_MAN.format(n=8)}),
e AS (SELECT path, unnest(ids) AS id FROM m), l AS (SELECT path, count(DISTINCT id) AS n FROM e WHERE id NOT IN (SELECT id FROM ent WHERE status = 'deleted') GROUP BY path)
SELECT m.path, CAST(coalesce(l.n, 0) AS INTEGER) AS n FROM m LEFT JOIN l USING (path) WHERE had = 0 OR l.n IS NOT NULL OR EXISTS (SELECT 1 FROM (SELECT path, unnest(entity_ids) AS id FROM {_MAN.format(n=8)}) z WHERE z.path = m.path AND z.id IS NULL)""",
    "manifest_rebuilt": f"WITH {_ENT} SELECT repo || '/' || file_path AS path, CAST(count(DISTINCT id) AS INTEGER) AS n FROM ent WHERE status <> 'deleted' AND file_path IS NOT NULL GROUP BY 1",
    "exception_names": f"WITH {_ENT}, nm AS (SELECT name FROM ent UNION SELECT unnest(bases) FROM class_infos UNION SELECT subject || 'Error' FROM subject_areas) SELECT regexp_matches(name, '(?i)(?:error|exception|warning|notfound|notsupported|forbidden|denied|invalid)$') AS is_exception, count(*) AS n FROM nm WHERE name IS NOT NULL GROUP BY 1",
    "module_paths": rf"SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', ''), '\.(?:{_KNOWN})$', ''), '/(?:index|__init__)$', ''), '/', '.') AS module FROM documents WHERE path IS NOT NULL",
    "factory_names": f"""WITH {_ENT}, n AS (SELECT DISTINCT regexp_replace(lower('make_' || name), '[^a-z0-9]+', '_', 'g') AS name FROM ent)
SELECT name, array_to_string(list_transform(string_split(substr(name, 6), '_'), lambda w: upper(w[1]) || w[2:]), '') AS made FROM n""",
    "entity_errors": "WITH r AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, type DESC, name DESC, status DESC, source DESC, kind DESC NULLS LAST) = 1), "
    "c AS (SELECT id, type, name, CASE WHEN type = 'function' THEN 'odd' ELSE status END AS status, CASE WHEN status <> 'stub' THEN source END AS source, CASE WHEN status = 'deleted' THEN 0 ELSE version END AS version, list_concat(coalesce(kind, []), CASE WHEN type = 'module' THEN [''] ELSE [] END) AS kind FROM r), e AS ("
    + " UNION ALL ".join(f"SELECT 'missing {c}' AS error FROM c WHERE coalesce({c}, '') = ''" for c in ("id", "type", "name", "status", "source"))
    + f" UNION ALL SELECT 'unknown status: ' || status FROM c WHERE status NOT IN ({_list(schema.STATUSES)}) UNION ALL SELECT 'version below 1' FROM c WHERE version < 1 UNION ALL SELECT 'empty kind' FROM c WHERE len(list_filter(coalesce(kind, []), lambda k: coalesce(k, '') = '')) > 0) SELECT error, count(*) AS n FROM e GROUP BY error",
    "hard_deleted": f"WITH {_ENT} SELECT type, status, count(*) AS n FROM ent WHERE status <> 'deleted' GROUP BY ALL",
    "purged_stubs": f"WITH {_ENT} SELECT CASE WHEN status = 'stub' THEN 'deleted' ELSE status END AS status, count(*) AS n, CAST(sum(CASE WHEN status = 'stub' THEN version + 1 ELSE version END) AS BIGINT) AS versions FROM ent GROUP BY 1",
    "updated_entity": "SELECT 'R:' || r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 'The South' ELSE r_name END AS name, lower(CASE WHEN r_regionkey = 0 THEN 'The South' ELSE r_name END) AS name_key, CASE WHEN r_regionkey = 0 THEN 2 ELSE 1 END AS version, CASE WHEN r_regionkey = 0 THEN 'renamed' ELSE '' END AS summary, CASE WHEN r_regionkey = 0 THEN '1' END AS fact, CASE WHEN r_regionkey = 0 THEN 'x,y' END AS tags FROM region",
    "stored_entities": f"WITH {_ENT} SELECT id, status, CASE WHEN status = 'stub' THEN version + 100 ELSE version END AS version FROM ent",
    "impact_by_hop": star.ORACLES["neighborhood_nation"].replace(" SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY id", ", m AS (SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY id) SELECT hop, count(*) AS n FROM m GROUP BY hop"),
    "context_tokens": f"WITH {_ENT} SELECT count(*) AS n, count(*) * 80 AS tokens FROM ent WHERE status <> 'deleted'",
}
