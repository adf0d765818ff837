"""Keyed merges over the graph tables: upsert, contribute, delete, delta, cleanup, stub resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import entity_id, name_key


def delta(files: DataFrame, manifest: DataFrame, *, compute_hashes: bool = True) -> DataFrame:
    """``path, change, hash, old_hash, entity_ids`` of a listing (``path, size, mtime, hash``) against a manifest.

    ``change`` is new, modified, deleted or unchanged.  Equal size and mtime (both
    known) are unchanged without looking at hashes, as are files whose hash or
    whose manifest hash is missing, or all known ones without ``compute_hashes``.
    """
    old = manifest.select("path", F.col("hash").alias("old_hash"), F.col("size").alias("_s"), F.col("mtime").alias("_m"), "entity_ids", F.lit(True).alias("_old"))
    new = files.select("path", "hash", "size", "mtime", F.lit(True).alias("_new"))
    same = (F.col("_s") > 0) & (F.col("_m") > 0) & (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m"))
    known = (F.coalesce("hash", F.lit("")) != "") & (F.coalesce("old_hash", F.lit("")) != "")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted")
    if compute_hashes:
        change = change.when(~F.coalesce(same, F.lit(False)) & known & (F.col("hash") != F.col("old_hash")), "modified")
    return new.join(old, "path", "full_outer").select("path", change.otherwise("unchanged").alias("change"), "hash", "old_hash", "entity_ids")


def upsert(entities: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """Merge rows (``name, type, source, status`` and any further entity columns) by normalised name.

    Unknown names are created with a stable id and version 1.  A deleted entity
    comes back and a stub is promoted by an active row, type and source replaced
    and id kept; any other known entity keeps type and source.  Non-null incoming
    columns overlay.  Of several incoming rows of a name the first by path,
    line and name counts.  Rows with an empty name are ignored.
    """
    cols = entities.columns
    fresh = incoming.withColumn("name_key", name_key(F.col("name"))).filter("name_key != ''")
    order = [F.coalesce(F.col(c), d) for c, d in (("file_path", F.lit("")), ("line_start", F.lit(0))) if c in fresh.columns]
    rest = [c for c in fresh.columns if c != "name_key"]
    one = fresh.groupBy("name_key").agg(F.min_by(F.struct(*rest), F.struct(*order, F.col("name"))).alias("n"))
    j = entities.withColumnRenamed("name_key", "_key").alias("o").join(one.alias("i"), F.col("o._key") == F.col("i.name_key"), "full_outer")
    old, is_new, touched = F.col("o.id"), F.col("o.id").isNull(), F.col("i.name_key").isNotNull()
    revive = touched & ((F.col("o.status") == "deleted") | ((F.col("o.status") == "stub") & (F.coalesce(F.col("i.n.status"), F.lit("active")) == "active")))

    def value(c: str) -> Column:
        kept = F.col("o._key") if c == "name_key" else F.col(f"o.{c}")
        given = F.col(f"i.n.{c}") if c in rest else F.lit(None).cast(dict(entities.dtypes)[c])
        if c == "id":
            return F.coalesce(old, entity_id(F.col("i.n.name")))
        if c == "name_key":
            return F.coalesce(kept, F.col("i.name_key"))
        if c == "name":
            return F.coalesce(kept, given)
        if c == "version":
            return F.when(is_new, 1).when(touched, kept + 1).otherwise(kept).cast("int")
        if c == "status":
            return F.when(is_new, F.coalesce(given, F.lit("active"))).when(revive, F.coalesce(given, F.lit("active"))).otherwise(kept)
        if c in ("type", "kind", "source"):
            return F.when(is_new | revive, F.coalesce(given, kept)).otherwise(kept)
        if c == "created":
            return F.coalesce(kept, at)
        if c == "updated":
            return F.when(touched, at).otherwise(kept)
        return F.coalesce(given, kept)

    return j.select(*[value(c).cast(dict(entities.dtypes)[c]).alias(c) for c in cols])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, kind, dst): least position, first non-empty note, all called methods in order; with ``source``, who contributed it if anyone did."""
    named = F.when(F.coalesce("note", F.lit("")) != "", F.col("note"))
    more = [F.max("source").alias("source")] if "source" in edges.columns else []
    return edges.groupBy("src", "kind", "dst").agg(
        F.min("pos").alias("pos"),
        F.min_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("note"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "called_methods"))), lambda s: F.coalesce(s["called_methods"], F.array().cast("array<string>"))))).alias("called_methods"), *more,
    ).select("src", "pos", "kind", "dst", "note", "called_methods", *(["source"] if more else []))


# columns that a scan reads from source; all others belong to whoever contributed them
READ = ["type", "kind", "name", "name_key", "summary", "file_path", "line_start", "line_end", "signature", "base_classes", "methods", "method_details", "called_methods", "decorators"]


def merge_scan(before: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The entities of the graph after a scan that found ``found``.

    What a scan reads from source is replaced; aliases, categories, tags,
    timeline, creation and custom facts of other names stay.  The version grows
    only if something read has changed.  A deleted entity comes back and a stub
    is promoted, type and source replaced; a stub never replaces an entity.
    Active entities of the scanner that were not found are retired.
    """
    cols = dict(before.dtypes)
    j = before.alias("b").join(found.alias("f"), F.col("b.id") == F.col("f.id"), "full_outer")
    old, lost = F.col("b.id").isNotNull(), F.col("b.status").isin("deleted", "stub")
    ours = F.col("f.id").isNotNull() & (~old | lost | (F.col("f.status") != "stub"))
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*READ, "status"]])
    gone = old & F.col("f.id").isNull() & (F.col("b.source") == "scanner") & (F.col("b.status") == "active")
    touched = (old & ours & ~same) | gone
    map_of = lambda c: F.coalesce(F.col(c), F.create_map().cast(cols["custom"]))
    scanned = F.map_filter(map_of("f.custom"), lambda k, v: v.isNotNull())
    custom = F.map_concat(F.map_filter(map_of("b.custom"), lambda k, v: ~F.map_contains_key(scanned, k)), scanned)
    note = F.array(F.struct(F.date_format(at, "yyyy-MM-dd").alias("date"), F.lit("removed from source").alias("event"), F.array().cast("array<string>").alias("ref_ids"))).cast(cols["timeline"])

    def value(c: str) -> Column:
        b, f = F.col(f"b.{c}"), F.col(f"f.{c}")
        if c in READ or c == "source_files":
            return F.when(ours, f).otherwise(b)
        special = {
            "status": F.when(gone, "deleted").when(ours, f).otherwise(b),
            "source": F.when(~old | (ours & lost), f).otherwise(b),
            "version": F.when(~old, f).when(touched, b + 1).otherwise(b),
            "updated": F.when(~old | touched, at).otherwise(b),
            "custom": F.when(old & ours, custom).otherwise(F.coalesce(b, f)),
            "timeline": F.when(gone, F.concat(F.coalesce(b, F.array().cast(cols["timeline"])), note)).otherwise(F.coalesce(b, f)),
        }
        return special.get(c, F.coalesce(b, f))

    return j.select(*[value(c).cast(cols[c]).alias(c) for c in cols])


def settle(entities: DataFrame, edges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after stubs are resolved to what they stand for and those that nothing active refers to are gone."""
    resolved = resolve_stubs(entities)
    wired = rewire(edges, resolved)
    kept = entities.join(resolved.select(F.col("stub_id").alias("id")), "id", "left_anti")
    unused = orphan_stubs(kept, wired)
    return kept.join(unused, "id", "left_anti").select(*entities.columns), wired


def resolve_stubs(entities: DataFrame) -> DataFrame:
    """``stub_id, entity_id``: the active entity each stub stands for.

    Tried in turn: a dotted name as a Python file, the same name, and the last
    part of a name of two parts if it starts upper case.  Ties go to the least id.
    """
    stubs = entities.filter("status = 'stub'").select(F.col("id").alias("stub_id"), "name")
    dotted = F.col("name").contains(".") & ~F.col("name").contains("/")
    last = F.element_at(F.split("name", r"\."), -1)
    tries = F.array(
        F.when(dotted, F.concat(F.translate(F.col("name"), ".", "/"), F.lit(".py"))),
        F.col("name"),
        F.when((F.size(F.split("name", r"\.")) == 2) & last.rlike("^[A-Z]"), last),
    )
    wanted = stubs.select("stub_id", F.posexplode(tries).alias("tier", "wanted")).filter("wanted is not null").select("stub_id", "tier", name_key(F.col("wanted")).alias("name_key"))
    active = entities.filter("status = 'active'").groupBy(name_key(F.col("name")).alias("name_key")).agg(F.min("id").alias("entity_id"))
    return wanted.join(active, "name_key").groupBy("stub_id").agg(F.min_by("entity_id", "tier").alias("entity_id"))


def rewire(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges with stubs replaced by what they stand for; edges that became equal are merged, self loops stay out."""
    known = edges.join(resolved.withColumnRenamed("stub_id", "dst"), "dst", "left")
    moved = known.select("src", "pos", "kind", F.coalesce("entity_id", "dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "pos", "kind", "dst")]).filter("src != dst")
    return merge_edges(moved)


def orphan_stubs(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs that no active entity refers to."""
    hit = edges.join(entities.filter("status = 'active'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return entities.filter("status = 'stub'").select("id").join(hit, "id", "left_anti")


def removed_symbols(children: DataFrame, current: DataFrame) -> DataFrame:
    """Children of re-scanned files that the new scan no longer has: ``parent, id``.

    ``children`` (``parent, id, source, file_path, parent_path``) is what the
    graph has, ``current`` (``parent, id``) what the scan found; only children the
    scanner made, in the file of their parent, are removed.
    """
    own = children.filter("source = 'scanner' and file_path = parent_path").join(current.select("parent").distinct(), "parent", "left_semi")
    return own.select("parent", "id").join(current, ["parent", "id"], "left_anti")


def retire(entities: DataFrame, gone: DataFrame, at: Column, event: str) -> DataFrame:
    """Soft delete of the entities in ``gone`` (``id``), with an event in the timeline."""
    marked = entities.join(gone.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    hit = F.coalesce("_gone", F.lit(False)) & (F.col("status") != "deleted")
    note = F.array(F.struct(F.date_format(at, "yyyy-MM-dd").alias("date"), F.lit(event).alias("event"), F.array().cast("array<string>").alias("ref_ids")))
    out = {"status": F.when(hit, "deleted").otherwise(F.col("status")), "updated": F.when(hit, at).otherwise(F.col("updated")), "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))}
    if "timeline" in entities.columns:
        out["timeline"] = F.when(hit, F.concat(F.coalesce("timeline", F.array().cast(dict(entities.dtypes)["timeline"])), note)).otherwise(F.col("timeline"))
    return marked.withColumns({k: v.cast(dict(entities.dtypes)[k]) for k, v in out.items() if k in entities.columns}).select(*entities.columns)


def retired_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, id`` of the entities of files that are gone."""
    return manifest.join(files.select("path"), "path", "left_anti").select("path", F.explode_outer("entity_ids").alias("id"))


def contribute(entities: DataFrame, edges: DataFrame, notes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Merge facts that agents contribute: ``entity_name, properties map, relations array<struct<target,kind,note>>, rationale, source``.

    Properties overlay, relations are added unless the (kind, target) is there,
    unknown targets become stubs of type other, relations without a target are
    skipped, and the rationale goes to the timeline.  A contribution without
    properties, relations and rationale changes nothing; one to an unknown
    entity is dropped.  Several contributions to an entity apply in the order of
    source and rationale.
    """
    keyed = notes.withColumn("name_key", name_key(F.col("entity_name"))).withColumn("n", F.size(F.coalesce("relations", F.array())) + F.size(F.coalesce("properties", F.create_map())) + F.length(F.coalesce("rationale", F.lit("")))).filter("n > 0")
    live = entities.filter("status != 'deleted'")
    hit = keyed.join(live.select("id", "name_key"), "name_key")
    rel = hit.select("id", F.coalesce("source", F.lit("agent")).alias("source"), F.posexplode("relations").alias("at", "r")).filter("coalesce(r.target, '') != ''").select(F.col("id").alias("src"), "at", "source", name_key(F.col("r.target")).alias("target_key"), "r.target", "r.kind", "r.note")
    stubs = rel.select("target_key", "target").groupBy("target_key").agg(F.min("target").alias("name")).join(live.select(F.col("name_key").alias("target_key")), "target_key", "left_anti")
    cols = dict(entities.dtypes)
    made = {"id": entity_id(F.col("name")), "name": F.col("name"), "name_key": F.col("target_key"), "type": F.lit("other"), "status": F.lit("stub"), "version": F.lit(1), "source": F.lit("stub"), "created": at, "updated": at}
    new = stubs.select(*[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()])
    targets = live.select(F.col("name_key").alias("target_key"), F.col("id").alias("dst")).unionByName(new.select(F.col("name_key").alias("target_key"), F.col("id").alias("dst")))
    added = rel.join(targets, "target_key").join(edges.select("src", "kind", "dst"), ["src", "kind", "dst"], "left_anti").select("src", (F.col("at") + 1_000_000).cast("int").alias("pos"), "kind", "dst", "note", F.array().cast("array<string>").alias("called_methods"), *(["source"] if "source" in edges.columns else []))
    event = F.struct(F.date_format(at, "yyyy-MM-dd").alias("date"), F.concat(F.lit("["), F.coalesce("source", F.lit("agent")), F.lit("] "), F.substring("rationale", 1, 300)).alias("event"), F.array().cast("array<string>").alias("ref_ids"))
    grouped = hit.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce("rationale", F.lit("")) != "", event))).alias("_events"),
        F.map_from_entries(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", "rationale", F.map_entries("properties").alias("p")))), lambda s: F.coalesce(s["p"], F.array().cast("array<struct<key:string,value:string>>"))))).alias("_props"),
    )
    base = entities.join(grouped, "id", "left")
    touched = F.col("_events").isNotNull()
    custom = F.map_from_entries(F.concat(F.map_entries(F.map_filter(F.coalesce("custom", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("_props", k), F.lit(False)))), F.map_entries(F.coalesce("_props", F.create_map().cast("map<string,string>")))))
    merged = base.withColumns({
        "custom": F.when(touched, custom).otherwise(F.col("custom")),
        "timeline": F.when(touched, F.concat(F.coalesce("timeline", F.array().cast(cols["timeline"])), F.col("_events").cast(cols["timeline"]))).otherwise(F.col("timeline")),
        "version": F.when(touched, F.col("version") + 1).otherwise(F.col("version")),
        "updated": F.when(touched, at).otherwise(F.col("updated")),
    }).select(*entities.columns)
    return merged.unionByName(new), merge_edges(edges.unionByName(added))


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """``language, n_files, n_entities``."""
    return manifest.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.greatest(F.size(F.coalesce("entity_ids", F.array().cast("array<string>"))), F.lit(0))).cast("bigint").alias("n_entities"))


def update(entities: DataFrame, name: str, changes: dict[str, object], at: Column, *, sections: dict[str, object] | None = None) -> DataFrame:
    """The entity of this id or name with columns replaced, custom facts overlaid and list items appended unless they are there.

    ``changes`` sets columns but id, created and version; a new ``name`` also
    changes the key.  ``sections`` maps ``custom`` to facts and list columns
    (aliases, categories, tags) to items.  Version and update time grow; an
    unknown name changes nothing.
    """
    cols = dict(entities.dtypes)
    hit = ((F.col("id") == name) | (F.col("name_key") == name_key(F.lit(name)))) & (F.col("status") != "deleted")
    out: dict[str, Column] = {}
    for c, v in changes.items():
        if c in ("id", "created", "version", "updated", "name_key"):
            raise ValueError(f"{c} cannot be set")
        out[c] = F.array(*map(F.lit, v)).cast(cols[c]) if isinstance(v, (list, tuple)) else F.lit(v).cast(cols[c])
    if "name" in changes:
        out["name_key"] = name_key(F.lit(changes["name"]))
    for c, v in (sections or {}).items():
        if isinstance(v, dict):
            new = F.create_map(*[F.lit(str(x)) for kv in v.items() for x in kv]).cast(cols[c])
            given = [*map(str, v)]
            out[c] = F.map_concat(F.map_filter(F.coalesce(F.col(c), F.create_map().cast(cols[c])), lambda k, _: ~k.isin(given)), new)  # noqa: B023 - called at once
        else:
            out[c] = F.array_union(F.coalesce(F.col(c), F.array().cast(cols[c])), F.array(*map(F.lit, v)).cast(cols[c]))
    out |= {"version": F.col("version") + 1, "updated": at}
    return entities.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(cols[c]) for c, v in out.items()})


def delete(entities: DataFrame, edges: DataFrame, ids: DataFrame, at: Column, *, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Delete the entities of ``ids`` (``id``): softly by status, or rows and edges."""
    if not hard:
        return retire(entities, ids, at, "deleted"), edges
    left = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return entities.join(ids.select("id"), "id", "left_anti").select(*entities.columns), left.select(*edges.columns)


def purge_stubs(entities: DataFrame, at: Column) -> DataFrame:
    """Entities with all stubs marked deleted, as before a full scan."""
    return retire(entities, entities.filter("status = 'stub'").select("id"), at, "stub purged")


def manifest_rows(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """Manifest rows whose path starts with ``prefix``, to be ordered by path."""
    return manifest.filter(F.col("path").startswith(prefix)) if prefix else manifest


def record_files(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with rows added, or those of their paths replaced."""
    return manifest.join(rows.select("path"), "path", "left_anti").select(*manifest.columns).unionByName(rows.select(*manifest.columns))


def forget_entities(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """The manifest without these entities (``id``); rows that had entities and have none left are dropped."""
    each = manifest.select("path", F.explode("entity_ids").alias("id"))
    left = each.join(ids.select("id"), "id", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("_left"))  # entities of one file
    had = F.size(F.coalesce("entity_ids", F.array().cast("array<string>"))) > 0
    return manifest.join(left, "path", "left").filter(~had | F.col("_left").isNotNull()).withColumn("entity_ids", F.coalesce("_left", "entity_ids")).select(*manifest.columns)


def files_of_entity(manifest: DataFrame, id: str) -> DataFrame:
    return manifest.filter(F.array_contains("entity_ids", id)).select("path")


def rebuild_manifest(entities: DataFrame) -> DataFrame:
    """Manifest rows from the provenance of the entities."""
    rows = entities.filter("status != 'deleted'").select("id", F.explode("source_files").alias("f"))
    return rows.groupBy("f.path").agg(F.max("f.hash").alias("hash"), F.array_sort(F.collect_set("id")).alias("entity_ids"), F.max("f.language").alias("language"), F.max("f.size").alias("size"))
