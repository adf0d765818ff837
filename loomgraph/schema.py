"""Schemas of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHOD = "struct<name:string,signature:string,line_start:int,line_end:int>"
CALL = "struct<receiver:string,method:string,via:string>"

ENTITIES = (
    "id string, seq bigint, type string, kind array<string>, name string, name_key string, status string, version int, source string, "
    "summary string, aliases array<string>, categories array<string>, tags array<string>, file_path string, line_start int, line_end int, "
    f"signature string, base_classes string, methods array<string>, method_details array<{METHOD}>, called_methods array<{CALL}>, "
    "decorators string, custom map<string,string>, timeline array<struct<date:string,event:string,ref_ids:array<string>>>, "
    "stubs array<string>, source_files array<struct<path:string,hash:string,line_from:int,line_to:int,language:string,size:bigint,scanned_at:string>>, "
    "created timestamp, updated timestamp"
)
EDGES = "src string, pos int, kind string, dst string, note string, called_methods array<string>, source string"  # source: who contributed the edge, null for what a scan found
NAMES = "name_key string, entity_id string, is_alias boolean"
MANIFEST = "path string, hash string, entity_ids array<string>, language string, size bigint, mtime double, last_scanned timestamp"
FINDINGS = (
    "id string, pattern_id string, severity string, owasp string, cwe string, fix string, file string, line int, language string, "
    "description string, snippet string, taint_reachable boolean, status string, notes string, first_seen timestamp, last_seen timestamp, risk_score int"
)
DEFS = f"path string, kind string, subkind string, name string, bases array<string>, decorators array<string>, docstring string, line_start int, line_end int, signature string, is_async boolean, methods array<{METHOD}>"
REFS = "path string, owner string, ref_kind string, target string, via string, level int, is_relative boolean, serialized boolean"

PARSED = "path string, hash string, language string, defs array<struct<{}>>, refs array<struct<{}>>".format(*(",".join(p.replace(" ", ":", 1) for p in s.split(", ")) for s in (DEFS, REFS)))

# The types and states an entity may have.
GENERAL_TYPES = "person place organization event concept object document media animal plant process product tool other".split()
SOFTWARE_TYPES = "module class function method interface component service package library config database endpoint test".split()
STATUSES = "active stub deleted planned deprecated experimental".split()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones null, others dropped."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def validation_errors(entities: DataFrame) -> DataFrame:
    """``id, errors``: what is wrong with each entity row; an empty list if nothing."""
    checks = [
        F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in ("id", "type", "name", "status", "source")
    ] + [
        F.when(~F.col("status").isin(STATUSES), F.concat(F.lit("unknown status: "), F.col("status"))),
        F.when(F.col("version") < 1, F.lit("version below 1")),
        F.when(F.exists(F.coalesce("kind", F.array()), lambda k: F.coalesce(k, F.lit("")) == ""), F.lit("empty kind")),
    ]
    return entities.select("id", F.filter(F.array(*checks), lambda e: e.isNotNull()).alias("errors"))
