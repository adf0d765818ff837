"""The engine's tools as Python functions over a published graph, and an optional line-based JSON-RPC shell.

Every function returns a DataFrame (``text`` renders a small one); only
``contribute``, ``scan`` and the security functions publish a new version.
"""

from __future__ import annotations

import inspect
import json
import re
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.text import name_key
from loomgraph.operators import build, graph, maintain, search, security
from loomgraph.operators.extract import extract
from loomgraph.session import scratch_scope, stage
from loomgraph.sources import files as source_files
from loomgraph.sources.registry import BackgroundRun
from loomgraph.sources.store import GraphStore


def _clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


class Engine:
    """Tools on one store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, GraphStore(spark, path)

    @property
    def entities(self) -> DataFrame:
        return self.store.load("entities")

    @property
    def edges(self) -> DataFrame:
        return self.store.load("edges")

    def _slim(self, found: DataFrame, slim: bool) -> DataFrame:
        cols = ["name", "file_path", "line_start"] if slim else ["name", "type", "kind", "status", "file_path", "line_start"]
        more = [] if slim else [F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5).alias("tags"), F.substring(F.coalesce("summary", F.lit("")), 1, 180).alias("summary")]
        return found.join(self.entities.select("id", *cols, *more), "id")

    # reading

    def context(self, query: str, entities: list[str] = (), detail_level: str = "medium", depth: int = 1, max_results: int = 30, slim: bool = False) -> DataFrame:
        found = search.context(self.entities, self.edges, query, anchors=list(entities), max_seeds=10, hops=_clamp(depth, 0, 2), detail=detail_level, max_results=_clamp(max_results, 1, 60))
        return self._slim(found, slim).orderBy(F.desc("score"), "hop", "id")

    def find(self, name: str, max_results: int = 10) -> DataFrame:
        """Exact name, else a method, else part of a name."""
        n = _clamp(max_results, 1, 20)
        by_name = search.find(self.entities, name, max_results=n)
        if not by_name.filter("tier = 0").isEmpty():
            return self._slim(by_name, False).orderBy("tier", "id")
        by_method = search.method_definitions(self.entities, name)
        if not by_method.isEmpty():
            return self._slim(by_method.orderBy("priority", "id").limit(n), False)
        return self._slim(by_name, False).orderBy("tier", "id")

    def impact(self, entity: str, depth: int = 2, via_kinds: list[str] | None = None, exclude_tests: bool = False, slim: bool = False) -> DataFrame:
        """Dependents of an entity, or of a method if no entity has the name."""
        if not graph.resolve(self.entities, entity).isEmpty():
            found = graph.impact(self.entities, self.edges, entity, depth=depth, kinds=via_kinds, exclude_tests=exclude_tests)
            return self._slim(found, slim).orderBy("hop", "id")
        return self.impact_method(entity, depth=depth, exclude_tests=exclude_tests, slim=slim)

    def impact_method(self, method: str, depth: int = 2, exclude_tests: bool = False, slim: bool = False) -> DataFrame:
        """Callers of a method, and what depends on them; class-level dependents if nothing calls it."""
        depth = _clamp(depth, 1, 4)
        bare = search.split_method(method)[1]
        classes = stage(search.method_definitions(self.entities, method).select("id"), "definitions")
        first = search.method_callers(self.entities, self.edges, classes, bare).select("id", "via")
        if first.isEmpty():
            first = search.callers(classes, self.edges, per_match=25).select(F.col("caller").alias("id"), F.concat("via", F.lit(" -> class")).alias("via"))
        paths = self.entities.select("id", F.coalesce("file_path", F.lit("")).alias("file_path"))
        if exclude_tests:
            from loomgraph.functions.text import is_test_path

            first = first.join(paths.filter(~is_test_path(F.col("file_path"))).select("id"), "id", "left_semi")
        first = stage(first.distinct(), "callers")
        out = first.withColumn("hop", F.lit(1))
        if depth > 1:
            back = self.edges.filter(F.col("kind").isin(graph.IMPACT_KINDS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("kind").alias("label"), "pos")
            more = graph.expand(first.select("id"), back, depth - 1).filter("hop > 0").join(classes, "id", "left_anti")
            out = out.unionByName(more.select("id", "via", (F.col("hop") + 1).alias("hop")))
        return self._slim(out, slim).orderBy("hop", "id")

    def path(self, from_entity: str, to_entity: str, max_hops: int = 6) -> DataFrame:
        return self._slim(graph.shortest_path(self.entities, self.edges, from_entity, to_entity, max_hops=max_hops), True).orderBy("step")

    def orphans(self, types: list[str] | None = None, include_modules: bool = False, max_results: int = 100) -> DataFrame:
        """Unreferenced entities by type and name, each with the total before the limit."""
        return graph.orphan_page(graph.orphans(self.entities, self.edges, types=types, include_modules=include_modules), _clamp(max_results, 1, 200)).orderBy("type", "name", "id")

    def visualize(self, entity: str, depth: int = 2, direction: str = "both", relations: list[str] | None = None, format: str = "mermaid", max_nodes: int = 40) -> DataFrame:
        ids, inner = graph.neighborhood(self.entities, self.edges, entity, depth=depth, direction=direction, kinds=relations, max_nodes=max_nodes)
        return graph.diagram(ids, inner, self.entities, form=format)

    def stats(self) -> DataFrame:
        return search.stats_by_type(self.entities).orderBy("type")

    def delta(self, project_root: str) -> DataFrame:
        listed = stage(source_files.prefilter(source_files.listing(self.spark, project_root)), "listing")
        texts = source_files.read_texts(source_files.stat_changed(listed, self.store.load("manifest")))
        hashed = listed.join(texts.select("path", source_files.content_hash(F.col("content")).alias("hash")), "path", "left")
        return maintain.delta(hashed, self.store.load("manifest")).filter("change != 'unchanged'").orderBy("path")

    # writing

    def contribute(self, entity_name: str, properties: dict | None = None, relations: list[dict] | None = None, rationale: str = "", source: str = "agent") -> DataFrame:
        """Add facts to an entity; only the rows it touches are written."""
        row = (entity_name, {k: str(v) for k, v in (properties or {}).items()}, [(r.get("target"), r.get("kind", "related_to"), r.get("note")) for r in relations or []], rationale, source)
        notes = self.spark.createDataFrame([row], "entity_name string, properties map<string,string>, relations array<struct<target:string,kind:string,note:string>>, rationale string, source string")
        keys = [name_key(F.lit(n)) for n in [entity_name, *[t for t, _, _ in row[2] if t]]]
        near = stage(self.entities.filter(F.col("name_key").isin(*keys)), "touched")
        edges = self.edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").select(*self.edges.columns)
        entities, edges = maintain.contribute(near, edges, notes, _now())
        entities = stage(entities, "contributed")
        self.store.publish({}, patches={"entities": entities, "edges": edges, "names": graph.names_of(entities)})
        return graph.resolve(self.entities, entity_name)

    def update(self, entity: str, changes: dict | None = None, sections: dict | None = None) -> DataFrame:
        """Set columns of an entity, overlay its facts, append to its lists; a new name is found from now on."""
        row = graph.resolve(self.entities, entity)
        new = stage(maintain.update(row, row.first()["id"] if not row.isEmpty() else "", changes or {}, _now(), sections=sections), "updated")
        self.store.publish({}, patches={"entities": new, "names": graph.names_of(new)})
        return graph.resolve(self.entities, (changes or {}).get("name", entity))

    def delete(self, entity: str, hard: bool = False) -> None:
        """Delete an entity: softly, or row and edges."""
        entities, edges = maintain.delete(self.entities, self.edges, graph.resolve(self.entities, entity).select("id"), _now(), hard=hard)
        tables = {"entities": entities, "names": graph.names_of(entities.filter("status != 'deleted'"))}
        self.store.publish(tables | ({"edges": edges} if hard else {}))

    def scan(self, project_root: str, incremental: bool = True) -> DataFrame:
        """Read what changed in the tree, resolve, merge and publish; returns the changes.

        An incremental scan opens only files whose size or time differ from the
        manifest's and parses only those whose content does; what the others
        define and refer to is kept with the graph, since references cross files.
        Contributed facts, relations and timelines stay.  Nothing changed means
        no new version.  ``counters`` tells what the last scan did.
        """
        at, manifest = _now(), self.store.load("manifest")
        tree = stage(source_files.listing(self.spark, project_root), "tree")
        listed = stage(source_files.prefilter(tree), "listing")
        todo = source_files.stat_changed(listed, manifest) if incremental else listed
        texts = stage(source_files.read_texts(todo).withColumn("hash", source_files.content_hash(F.col("content"))), "texts")
        hashed = listed.join(texts.select("path", "hash"), "path", "left")
        changes = stage(maintain.delta(hashed, manifest).filter("change != 'unchanged'"), "changes")
        if incremental and changes.isEmpty():
            self.counters = self._counted(listed, texts, changes, None)
            return changes
        # definitions and references: of changed files anew, of all others as they were
        fresh = texts.filter(source_files.skip_reason(F.col("content")).isNull())
        if incremental:
            fresh = fresh.join(changes.select("path"), "path", "left_semi")
        read = stage(extract(fresh.withColumn("language", source_files.scan_language(F.col("path")))), "parsed")
        parsed = read.join(fresh.select("path", "hash"), "path")
        if incremental:
            known = self.store.load("parsed").join(changes.select("path"), "path", "left_anti").join(listed.select("path"), "path", "left_semi")
            parsed = known.select("path", "hash", "language", "defs", "refs").unionByName(parsed.select("path", "hash", "language", "defs", "refs"))
        parsed = stage(parsed, "parsed-all")
        entities, edges = build.build(parsed, at)
        guids = source_files.asset_guids(tree.join(listed.select(F.concat("path", F.lit(".meta")).alias("path")), "path", "left_semi"))
        edges = edges.unionByName(build.guid_edges(parsed.select(F.inline("refs")), guids, entities))
        entities = stage(maintain.merge_scan(self.entities, entities, at), "merged")
        given = self.edges.filter("source is not null")
        edges = maintain.merge_edges(schema.conform(edges, schema.EDGES).unionByName(given))
        entities, edges = maintain.settle(entities, stage(edges, "merged-edges"), at)
        entities = stage(entities, "settled")
        owners = entities.filter("status = 'active'").groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
        rows = maintain.record_files(manifest.join(listed.select("path"), "path", "left_semi"), source_files.manifest_of(texts.select("path", "hash"), listed, at))
        rows = rows.join(owners, "path", "left").withColumn("entity_ids", F.coalesce("ids", F.array().cast("array<string>"))).drop("ids")
        self.store.publish({"entities": entities, "edges": edges, "names": graph.names_of(entities.filter("status != 'deleted'")), "manifest": rows, "parsed": parsed})
        self.counters = self._counted(listed, texts, changes, read)
        return changes

    counters: dict = {}

    def _counted(self, listed: DataFrame, texts: DataFrame, changes: DataFrame, read: DataFrame | None) -> dict:
        """What a scan did: files listed, opened, parsed and failed, changes by kind, and the graph's sizes."""
        kinds = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        graph_now = self.entities.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()
        return {
            "files": listed.count(), "opened": texts.count(), "skipped": texts.filter(source_files.skip_reason(F.col("content")).isNotNull()).count(),
            "parsed": read.count() if read is not None else 0, "failed": read.filter("parse_error is not null").count() if read is not None else 0,
            **{k: kinds.get(k, 0) for k in ("new", "modified", "deleted")}, **{f"entities_{r['status']}": r["n"] for r in graph_now}, "relations": self.edges.count(), "version": self.store.version(),
        }

    def preview(self, project_root: str) -> DataFrame:
        """Suffixes of a tree, the most frequent first."""
        return source_files.preview(source_files.listing(self.spark, project_root))

    def cleanup(self, project_root: str) -> DataFrame:
        """Retire the entities of files that are gone from the tree; returns them."""
        manifest = self.store.load("manifest")
        gone = stage(maintain.retired_files(manifest, source_files.listing(self.spark, project_root)).filter("id is not null"), "gone")
        if not gone.isEmpty():
            touched = self.entities.join(gone.select("id").distinct(), "id", "left_semi").select(*self.entities.columns)
            self.store.publish({"manifest": manifest.join(gone.select("path").distinct(), "path", "left_anti")}, patches={"entities": maintain.retire(touched, gone.select("id"), _now(), "file removed")})
        return gone

    def security(self, project_root: str, severity: str = "medium", language: str = "", owasp: str = "", file: str = "", max_results: int = 50, include_false_positives: bool = False) -> DataFrame:
        listed = source_files.listing(self.spark, project_root)
        found = security.scan(source_files.read_texts(security.scannable(listed)))
        kept = security.carry_review(found, self.store.load("findings"), _now())
        kept = kept.withColumn("risk_score", security.risk_points(F.col("severity"), F.coalesce("taint_reachable", F.lit(False))).cast("int"))
        self.store.publish({"findings": kept})
        return security.display(self.store.load("findings"), severity=severity, language=language, owasp=owasp, file=file, hide_false_positives=not include_false_positives, max_results=max_results)

    def security_triage(self, status: str, id: str = "", file: str = "", notes: str | None = None) -> DataFrame:
        self.store.publish({"findings": security.triage(self.store.load("findings"), status, id=id or None, file=file or None, notes=notes)})
        return security.severity_counts(self.store.load("findings"))


def _now():
    return F.lit(datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0).isoformat()).cast("timestamp")


TOOLS = ("context", "impact", "path", "find", "orphans", "visualize", "contribute", "stats", "delta", "scan", "security", "security_triage")


_KINDS = {"str": "string", "int": "integer", "bool": "boolean", "dict": "object", "list": "array"}


def input_schema(tool: str) -> dict:
    """JSON schema of a tool's arguments, from its signature."""
    out: dict = {"type": "object", "properties": {}, "required": []}
    for name, p in list(inspect.signature(getattr(Engine, tool)).parameters.items())[1:]:
        kind = _KINDS[re.match(r"\w+", str(p.annotation)).group()]
        out["properties"][name] = {"type": kind}
        if p.default is inspect.Parameter.empty:
            out["required"].append(name)
        elif p.default is not None:
            out["properties"][name]["default"] = list(p.default) if isinstance(p.default, tuple) else p.default
    return out


# Methods and paths of the service; each names the tool that answers.
ROUTES = {
    ("POST", "/preview"): "preview", ("POST", "/scan"): "scan", ("GET", "/scan/status"): "scan_status", ("POST", "/scan/cancel"): "scan_cancel", ("GET", "/stats"): "stats", ("GET", "/query/cache"): "cache",
    ("POST", "/query/impact"): "impact", ("POST", "/query/context"): "context", ("POST", "/query/path"): "path", ("POST", "/query/find"): "find", ("POST", "/query/orphans"): "orphans", ("POST", "/query/visualize"): "visualize",
    ("POST", "/security/scan"): "security", ("POST", "/security/triage"): "security_triage", ("POST", "/delta"): "delta", ("POST", "/cleanup"): "cleanup", ("GET", "/mcp/tools"): "tools", ("POST", "/contribute"): "contribute",
}


def route(engine: Engine, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and JSON answer of a request: rows of the tool's result, at most 500."""
    if path in ("/", "/health"):
        return 200, {"status": "ok"}
    name = ROUTES.get((method, path.rstrip("/")))
    if name is None:
        return 404, {"error": f"no such route: {method} {path}"}
    if name == "tools":
        return 200, {"tools": [{"name": t, "inputSchema": input_schema(t)} for t in TOOLS]}
    if name == "cache":
        return 200, {"version": engine.store.version()}
    run = engine.__dict__.get("running")
    if name == "scan_status":
        return 200, {**(run.status() if run else {"state": "idle"}), "counters": engine.counters}
    if name == "scan_cancel":
        if run:
            run.cancel()
        return 200, {"cancelled": run is not None}
    try:
        if name == "scan" and body.pop("background", False):
            if run and run.status()["state"] == "running":
                return 409, {"error": "a scan is running"}
            engine.running = BackgroundRun(engine.spark, lambda: engine.scan(**body), "scan")
            return 202, {"state": "running"}
        with scratch_scope(engine.spark):
            found = getattr(engine, name)(**body)
            return 200, {"rows": [json.loads(r) for r in found.limit(500).toJSON().collect()] if found is not None else []}
    except (TypeError, ValueError) as ex:
        return 400, {"error": str(ex)}


def serve_http(engine: Engine, port: int = 8787) -> None:
    """A small server over ``route``; it ends with the process."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                status, out = route(engine, self.command, self.path.split("?")[0], json.loads(self.rfile.read(size) or b"{}"))
            except json.JSONDecodeError as ex:
                status, out = 400, {"error": str(ex)}
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()


def text(df: DataFrame, limit: int = 200) -> str:
    """Plain text of a small result."""
    rows = df.limit(limit).toPandas()
    return "nothing found" if rows.empty else rows.to_string(index=False)


def handle(engine: Engine, message: dict) -> dict | None:
    """One JSON-RPC message to its answer; None for notifications."""
    if "id" not in message:
        return None
    answer: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "1"}}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        return answer | {"result": {"tools": [{"name": t, "description": (getattr(Engine, t).__doc__ or t).strip(), "inputSchema": input_schema(t)} for t in TOOLS]}}
    if method == "tools/call":
        if params.get("name") not in TOOLS:
            return answer | {"error": {"code": -32601, "message": f"unknown tool: {params.get('name')}"}}
        try:
            with scratch_scope(engine.spark):
                body, bad = text(getattr(engine, params["name"])(**(params.get("arguments") or {}))), False
        except Exception as ex:  # noqa: BLE001 - a tool's failure is its result
            body, bad = f"{type(ex).__name__}: {ex}", True
        return answer | {"result": {"content": [{"type": "text", "text": body}], "isError": bad}}
    return answer | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(engine: Engine, lines=sys.stdin, write: Callable[[str], object] = print) -> None:
    for line in lines:
        if line.strip():
            answer = handle(engine, json.loads(line))
            if answer is not None:
                write(json.dumps(answer))


__all__ = ["Engine", "TOOLS", "handle", "schema", "serve", "text"]
