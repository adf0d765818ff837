"""The pN_ queries of the general problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import clean_hash, clean_path, name_key
from loomgraph.operators.hierarchy import hierarchy
from loomgraph.operators.incremental import VersionedTable, take_up, versions_by_cutoff
from loomgraph.operators.references import orphan_references, orphan_report
from loomgraph.operators.snapshot_diff import snapshot_diff
from loomgraph.session import scratch_path, stage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of manifest files and findings between consecutive deliveries of a repo."""
    manifest = table(spark, sf_dir, "manifest_snapshots").select(
        F.lit("manifest_snapshots").alias("src"), "repo", "snap_no", clean_path(F.col("path")).alias("rec_key"), "delivered_at",
        clean_hash(F.col("hash")).alias("a"), F.col("size").cast("string").alias("b"), F.col("mtime").cast("string").alias("c"),
    )
    findings = table(spark, sf_dir, "findings").select(
        F.lit("findings").alias("src"), "repo", "snap_no", F.col("id").alias("rec_key"), "delivered_at",
        F.lower(F.trim(F.col("pattern_id"))).alias("a"), F.lower(F.trim(F.col("severity"))).alias("b"), F.col("status").alias("c"),
    )

    def modified(old, new):
        a, b, c = (~old(x).eqNullSafe(new(x)) for x in "abc")
        # a null a is a hash that was not computed; pattern ids are never null
        file = F.when(old("a").isNull() | new("a").isNull(), b | c).otherwise(a)
        return F.when(F.col("src") == "findings", a | b | c).otherwise(file)

    return snapshot_diff(
        manifest.unionByName(findings), table(spark, sf_dir, "snapshot_log"), scope=["src", "repo"], deliveries_scope=["repo"],
        version="snap_no", key="rec_key", state=["a", "b", "c"], order=["delivered_at"], modified=modified,
    )


def _current(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The greatest row of each key; equal times go to the greatest fields."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(order).alias("_at"), *fields)).alias("_c")).select(key, *[F.col(f"_c.{f}").alias(f) for f in fields])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forests: containers of classes, and classes by their first base."""
    boxes = _current(table(spark, sf_dir, "ingest_results"), "module_entity_id", "ingested_at", ["class_entity_ids"])
    none = F.lit(None).cast("string")
    inside = boxes.select(F.explode("class_entity_ids").alias("id"), F.col("module_entity_id").alias("parent"))
    contains = boxes.select(F.col("module_entity_id").alias("id"), none.alias("parent")).union(inside).withColumn("forest", F.lit("contains"))
    classes = _current(table(spark, sf_dir, "class_infos"), "class_id", "scanned_at", ["repo", "name", "bases"])
    classes = stage(classes.select("repo", F.col("class_id").alias("id"), name_key(F.col("name")).alias("own"), name_key(F.get("bases", F.lit(0))).alias("base")), "classes")
    named = classes.filter("own is not null").groupBy("repo", F.col("own").alias("base")).agg(F.min("id").alias("parent"))
    extends = classes.join(named, ["repo", "base"], "left").select("id", "parent", F.lit("extends").alias("forest"))
    found = hierarchy(contains.unionByName(extends), group=["forest"])
    return found.select("forest", F.col("id").alias("node_id"), "state", F.col("root").alias("root_id"), "depth", F.col("n_desc").cast("int").alias("n_desc"), F.col("path").alias("node_path"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes = table(spark, sf_dir, "class_infos").select(F.col("class_id").alias("ref_key"), "repo", "bases", F.col("calls.callee_name").alias("calls"), F.col("scanned_at").alias("at"))
    named = classes.select(
        F.lit("class_infos").alias("src_table"), "ref_key", "repo", "at",
        F.explode(F.array(F.struct(F.lit("bases").alias("field"), F.col("bases").alias("names")), F.struct(F.lit("calls").alias("field"), F.col("calls").alias("names")))).alias("x"),
    ).select("src_table", "ref_key", "repo", "at", "x.field", F.explode("x.names").alias("name"))
    by_name = named.withColumn("target", name_key(F.col("name"))).drop("name")
    by_id = table(spark, sf_dir, "stub_resolutions").select(
        F.lit("stub_resolutions").alias("src_table"), F.col("stub_id").alias("ref_key"), "repo", F.col("resolved_at").alias("at"), F.lit("entity_id").alias("field"), F.col("entity_id").alias("target")
    )
    return by_name, by_id


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name, by_id = _references(spark, sf_dir)
    entities = stage(_current(table(spark, sf_dir, "entities"), "id", "version", ["repo", "name_key", "status", "created"]), "entities")
    kinds = {"deleted": "status = 'deleted'", "created": "created", "at": "at", "match": "simple"}
    return orphan_references(by_name, entities, on={"repo": "repo", "target": "name_key"}, **kinds).unionByName(
        orphan_references(by_id, entities, on={"target": "id"}, **kinds)
    ).withColumn("period", F.date_format("at", "yyyy-MM"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of classes and stub resolutions to entities that are missing, deleted or late."""
    return _orphans(spark, sf_dir).select("src_table", "ref_key", "field", "target", "period", "reason").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month, with the reference count and rate."""
    by_name, by_id = _references(spark, sf_dir)
    refs = by_name.unionByName(by_id).filter("target is not null").withColumn("period", F.date_format("at", "yyyy-MM"))
    return orphan_report(_orphans(spark, sf_dir), refs, by=["src_table", "period"])


def p3_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that containers list, by repository and id: where the id is null, the repository alone must have an entity."""
    rows = table(spark, sf_dir, "ingest_results").select(F.col("module_entity_id").alias("ref_key"), "repo", F.explode("class_entity_ids").alias("target"), F.col("ingested_at").alias("at"))
    entities = stage(_current(table(spark, sf_dir, "entities"), "id", "version", ["repo", "status", "created"]), "entities")
    found = orphan_references(rows, entities, on={"repo": "repo", "target": "id"}, at="at", match="partial", deleted="status = 'deleted'", created="created")
    return found.select("ref_key", "repo", "target", "reason").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each successful scan run must take up: one incremental run per done cutoff, each over its own delta."""
    runs = table(spark, sf_dir, "scan_runs").filter("status = 'done' and cutoff_at is not null").groupBy("cutoff_at").agg(F.min("run_id").alias("run_id")).orderBy("cutoff_at").collect()  # a run log: a row per run
    rows = table(spark, sf_dir, "file_status").select("repo", "path", "arrived_at", "last_scanned", "status_id", F.when(F.col("hash") != "", F.col("hash")).alias("hash"))
    if not runs:
        return spark.createDataFrame([], "run_id bigint, repo string, path string")
    log = versions_by_cutoff(spark, scratch_path(spark, "file-status"), rows, "arrived_at", [r["cutoff_at"] for r in runs])
    taken = VersionedTable(spark, scratch_path(spark, "taken-up"))
    for version in range(len(runs)):
        take_up(log, taken, key=["repo", "path"], state="hash", order=["last_scanned", "status_id"], upto=version)
    if not taken.manifest(taken.latest())["files"]:
        return spark.createDataFrame([], "run_id bigint, repo string, path string")
    run_of = F.element_at(F.array(*[F.lit(r["run_id"]).cast("bigint") for r in runs]), F.col("_version") + 1)
    return taken.read().filter("changed").select(run_of.alias("run_id"), "repo", "path")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p3_partial": p3_partial, "p7_found": p7_found}
