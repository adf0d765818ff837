"""A versioned store of the graph tables with atomic publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph import schema

TABLES = {"entities": schema.ENTITIES, "edges": schema.EDGES, "names": schema.NAMES, "manifest": schema.MANIFEST, "findings": schema.FINDINGS, "parsed": schema.PARSED}
KEYS = {"entities": ["id"], "edges": ["src", "kind", "dst"], "names": ["name_key"], "manifest": ["path"], "findings": ["id"], "parsed": ["path"]}


class GraphStore:
    """Tables below ``path``; readers follow a pointer that is replaced in one rename.

    A table is one set of files, and after it the patches of later versions: rows
    that replace those of the same key.  A change of a few rows thus writes a few
    rows; publishing the whole table again takes the patches in.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)

    def _pointer(self) -> dict | None:
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("_published"))) if self._fs.exists(self._at("_published")) else []
        found = [f for f in found if f.endswith(".json")]
        if not found:
            return None
        stream = self._fs.open(self._at(f"_published/{found[-1]}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def version(self) -> int:
        p = self._pointer()
        return p["version"] if p else 0

    def publish(self, tables: dict[str, DataFrame], *, patches: dict[str, DataFrame] | None = None) -> int:
        """Write whole tables, and patches of others, and make them current together; what is not given stays as it is."""
        before = self._pointer() or {"version": 0, "tables": {}}
        now = dict(before["tables"])
        for name, df in tables.items():
            now[name] = [self._write(name, df)]
        for name, df in (patches or {}).items():
            now[name] = [*now.get(name, []), self._write(name, df)]
        version = before["version"] + 1
        self._fs.mkdirs(self._at("_published"))
        temp, final = self._at(f"_published/.{uuid.uuid4().hex}"), self._at(f"_published/{version:012d}.json")
        out = self._fs.create(temp, False)
        out.write(json.dumps({"version": version, "tables": now}).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    def _write(self, name: str, df: DataFrame) -> str:
        rel = f"{name}/{uuid.uuid4().hex}"
        schema.conform(df, TABLES[name]).write.option("compression", "zstd").parquet(f"{self.path}/{rel}")
        return rel

    def load(self, name: str) -> DataFrame:
        """The current table, empty if it was never published."""
        p = self._pointer()
        parts = [self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{rel}") for rel in (p["tables"].get(name, []) if p else [])]
        if not parts:
            return schema.empty(self.spark, TABLES[name])
        out = parts[0]
        for patch in parts[1:]:
            out = out.join(patch.select(*KEYS[name]), KEYS[name], "left_anti").select(*out.columns).unionByName(patch)
        return out

    def drop(self) -> None:
        """Forget what is published; the next reader finds empty tables."""
        self._fs.delete(self._at("_published"), True)
