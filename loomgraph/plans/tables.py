"""Queries of the graph engine over the code-graph tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import clean_path, content_hash, entity_id, finding_id, is_handler_file, is_test_file, name_key, stem, suffix
from loomgraph.operators import graph, maintain, search, security
from loomgraph.operators.build import build
from loomgraph.operators.extract import extract
from loomgraph.sources import files as source_files
from loomgraph.session import stage, table

NOW = "2031-01-01"


def _latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    ordered = order + [c for c in rest if c not in order]
    return df.groupBy(*key).agg(F.max(F.struct(*ordered)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in rest])


def current_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of every entity."""
    e = table(spark, sf_dir, "entities").select("id", "repo", "type", "name", "name_key", "status", "version", "summary", "file_path", "line_start")
    return _latest(e, ["id"], ["version"])


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "class_infos").select("class_id", "repo", "name", "bases", "calls", "scanned_at")
    return _latest(c, ["class_id"], ["scanned_at", "repo", "name", "bases", "calls"])


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extends and calls edges of the current classes, names resolved in their repo; what has no live entity is left out."""
    names = stage(current_entities(spark, sf_dir).filter("status != 'deleted'").groupBy("repo", "name_key").agg(F.min("id").alias("dst")), "names")
    c = _classes(spark, sf_dir).select("class_id", "repo", F.explode(F.concat(F.transform(F.coalesce("bases", F.array()), lambda b: F.struct(F.lit("extends").alias("kind"), b.alias("name"))), F.transform(F.coalesce("calls.callee_name", F.array()), lambda b: F.struct(F.lit("calls").alias("kind"), b.alias("name"))))).alias("r"))
    wanted = c.select(F.col("class_id").alias("src"), "repo", "r.kind", name_key(F.col("r.name")).alias("name_key")).filter("name_key is not null")
    return wanted.join(names, ["repo", "name_key"]).select("src", "kind", "dst").distinct()


def code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stats_by_type(current_entities(spark, sf_dir))


def code_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with five callers or more."""
    return graph.hubs(entity_edges(spark, sf_dir), least=5)


def code_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that no class extends or calls."""
    e = current_entities(spark, sf_dir)
    edges = entity_edges(spark, sf_dir).withColumn("pos", F.lit(0))
    return graph.orphans(e, edges, types=["class"]).select("id", "name", "file_path")


def code_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the class that most classes refer to."""
    e = stage(current_entities(spark, sf_dir).withColumn("seq", F.lit(0)), "entities")
    edges = stage(entity_edges(spark, sf_dir).withColumn("pos", F.lit(0)), "edges")
    live = e.filter("status != 'deleted'").select(F.col("id").alias("dst"))
    top = edges.join(live, "dst", "left_semi").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return graph.impact(e, edges, top["dst"] if top else "", depth=3, strict_depth=True).select("id", "hop")


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the number of repos that use them."""
    e = current_entities(spark, sf_dir).filter("status != 'deleted'")
    return e.groupBy(name_key(F.col("name")).alias("name_key")).agg(F.count_distinct("repo").alias("n_repos"), F.count(F.lit(1)).alias("n"))


def stub_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active entities that stubs stand for, by name in any repo; each class also has a stub of its dotted name."""
    e = current_entities(spark, sf_dir).select("id", "name", "status")
    dotted = e.filter("status = 'active'").select(F.concat(F.lit("stub of "), "id").alias("id"), F.concat(F.lit("pkg."), "name").alias("name"), F.lit("stub").alias("status"))
    return maintain.resolve_stubs(e.unionByName(dotted))


def rewired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with resolved stubs replaced, merged per (source, kind, target)."""
    stubs = table(spark, sf_dir, "stub_resolutions").filter("entity_id is not null").groupBy("stub_id").agg(F.max_by("entity_id", F.struct("resolved_at", "entity_id")).alias("entity_id"))
    edges = entity_edges(spark, sf_dir).select("src", F.lit(0).alias("pos"), "kind", "dst", F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("called_methods"))
    return maintain.rewire(edges, stubs).select("src", "kind", "dst")


def unused_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.orphan_stubs(current_entities(spark, sf_dir), entity_edges(spark, sf_dir))


def _manifest(spark: SparkSession, sf_dir: str, snap: int) -> DataFrame:
    m = table(spark, sf_dir, "manifest_snapshots").filter(F.col("snap_no") == snap)
    m = m.select(F.concat_ws("/", "repo", clean_path(F.col("path"))).alias("path"), "delivered_at", F.regexp_replace(F.lower("hash"), "^sha256:", "").alias("hash"), "entity_ids", "language", "size", "mtime")
    return _latest(m, ["path"], ["delivered_at", "hash", "size", "mtime", "language", "entity_ids"])


def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot as a listing against the first as the manifest."""
    return maintain.delta(_manifest(spark, sf_dir, 2), _manifest(spark, sf_dir, 1)).select("path", "change")


def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.manifest_stats(_manifest(spark, sf_dir, 8))


def retired_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of files that the last snapshot no longer has."""
    return maintain.retired_files(_manifest(spark, sf_dir, 7), _manifest(spark, sf_dir, 8)).filter("id is not null").distinct()


def removed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that outdated ingests list and the current ingest of their container does not."""
    rows = table(spark, sf_dir, "ingest_results").select(F.col("module_entity_id").alias("parent"), "class_entity_ids", "ingested_at", "path")
    now = _latest(rows, ["parent"], ["ingested_at", "class_entity_ids", "path"]).select("parent", F.explode_outer("class_entity_ids").alias("id"))
    ever = rows.select("parent", F.explode("class_entity_ids").alias("id"), F.lit("scanner").alias("source"), F.col("path").alias("file_path"), F.col("path").alias("parent_path")).filter("id is not null").distinct()
    return maintain.removed_symbols(ever, now).distinct()


def upserted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all entities merged by name: first versions, then current ones on top."""
    e = current_entities(spark, sf_dir).filter("status != 'deleted'")
    base = e.filter("type = 'module'").groupBy(name_key(F.col("name")).alias("name_key")).agg(F.min("name").alias("name")).select(
        entity_id(F.col("name")).alias("id"), "name", "name_key", F.lit("module").alias("type"), F.lit("active").alias("status"), F.lit(1).alias("version"), F.lit("scan").alias("source"),
        F.lit(NOW).cast("timestamp").alias("created"), F.lit(NOW).cast("timestamp").alias("updated"),
    )
    incoming = e.select("name", "type", F.lit("scan").alias("source"), "status", "file_path", "line_start")
    return maintain.upsert(base, incoming, F.lit(NOW).cast("timestamp")).select("id", "name_key", "version")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "findings").select("id", "snap_no", "repo", F.lower(F.trim("pattern_id")).alias("pattern_id"), F.lower(F.trim("severity")).alias("severity"), "owasp", "file", "line", "snippet", F.coalesce("taint_reachable", F.lit(False)).alias("taint_reachable"), "status", "delivered_at")
    return _latest(f, ["id"], ["snap_no", "delivered_at", "pattern_id", "severity", "status", "file", "line"])


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.severity_counts(_findings(spark, sf_dir))


def owasp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.owasp_counts(_findings(spark, sf_dir))


def file_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.file_risk(_findings(spark, sf_dir), top=5)


def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.risk_level(_findings(spark, sf_dir))


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "findings").select("file", F.lower(F.trim("pattern_id")).alias("pattern_id"), "snippet").distinct()
    return f.select("file", "pattern_id", finding_id(F.col("file"), F.col("pattern_id"), F.col("snippet")).alias("stable_id")).distinct()


def finding_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with findings, by what their path says."""
    f = table(spark, sf_dir, "findings").select("file").distinct()
    return f.groupBy(is_test_file(F.col("file")).alias("is_test"), is_handler_file(F.col("file")).alias("is_handler")).agg(F.count(F.lit(1)).alias("n"))


def triage_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review status carried from the seventh to the eighth snapshot."""
    f = table(spark, sf_dir, "findings")
    pick = lambda n: _latest(f.filter(F.col("snap_no") == n).select("id", "file", F.when(F.col("status") == "fixed", "resolved").when(F.col("status") == "accepted", "verified_vulnerability").otherwise(F.col("status")).alias("status"), "notes", "first_seen", "delivered_at"), ["id"], ["delivered_at", "status", "notes", "first_seen", "file"])
    before = pick(7).select("id", "file", "status", "notes", "first_seen")
    return security.carry_review(pick(8).select("id", "file"), before, F.lit(NOW).cast("timestamp_ntz")).select("id", "status")


def scan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits in all documents, per rule and language."""
    d = table(spark, sf_dir, "documents").select("path", F.col("text").alias("content"))
    return security.rule_hits(security.scannable(d)).groupBy("rule_id", "language").agg(F.count(F.lit(1)).alias("n"))


LINE_RULES = {"aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "url_password": r"[a-z]+://[^\s:/@]+:[^\s/@]+@", "math_random": r"Math\.random\(", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents by a few expressions, without leaving the JVM."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return security.line_hits(lines, "line", LINE_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def docs_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce(F.nullif("lang", F.lit("")), source_files.manifest_language(F.col("path"))).alias("language"), F.length("text").alias("n"))
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


def duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents have; the digest is what is grouped, not the text."""
    d = table(spark, sf_dir, "documents").filter("text != ''").select(content_hash(F.col("text")).alias("hash"), "source")
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_sources")).filter("n_docs > 1")


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.coalesce(source_files.skip_reason(F.col("text")), F.lit("none")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files.preview(table(spark, sf_dir, "documents").select("path"))


def scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scan would look at, by suffix."""
    d = table(spark, sf_dir, "documents").select("path", F.length("text").cast("bigint").alias("size"))
    return source_files.prefilter(d).groupBy(suffix(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def path_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("ext"))


def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph built from all documents: entities and edges by kind."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "path").alias("path"), source_files.scan_language(F.col("path")).alias("language"), F.col("text").alias("content"))
    entities, edges = build(stage(extract(d), "parsed"), F.lit(NOW).cast("timestamp"))
    return entities.groupBy(F.concat_ws(" ", "status", "type").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, parted by gaps of more than thirty minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id").withColumn("new", F.when(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) > 1_800_000_000, F.lit(True)), 1).otherwise(0))
    return e.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "n", "first_ts", "last_ts")


QUERIES = {
    f.__name__: f
    for f in (
        current_entities, entity_edges, code_stats, code_hubs, code_orphans, code_impact, name_index, stub_matches, rewired_edges, unused_stubs, manifest_delta, manifest_stats,
        retired_entities, removed_children, upserted_entities, severity_counts, owasp_counts, file_risk, risk_level, finding_ids, finding_paths, triage_carry, scan_hits, line_hits,
        docs_by_lang, doc_hashes, duplicate_docs, skip_reasons, preview, scan_candidates, path_stems, built_graph, event_windows, event_sessions,
    )
}
