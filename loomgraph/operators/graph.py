"""Traversals of a property graph: entities (nodes) and edges (src, pos, kind, dst, note).

A traversal is a bounded loop on the driver over frontier joins; each hop is
staged on shared storage, so plans stay flat and an executor may be lost.  The
frontier is deduplicated before it meets the edges again, and joins are left to
the optimizer, which sees the staged sizes: a small frontier is broadcast, a
large one shuffled.  Edges are read once a hop, filters and columns pushed into
the scan: they should be a stored table, or staged by the caller.  Whether a node
exists is asked of the nodes met, never of all edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_exception_name, is_test_path, name_key
from loomgraph.functions.vocab import IMPACT_KINDS, OUTBOUND_KINDS, SEMANTIC_KINDS
from loomgraph.session import stage

HUB_CALLERS = 20


def names_of(entities: DataFrame) -> DataFrame:
    """``name_key, entity_id, is_alias``: one entity per key, names before aliases, then the first inserted."""
    own = entities.select(name_key(F.col("name")).alias("name_key"), F.col("id").alias("entity_id"), F.lit(False).alias("is_alias"), "seq")
    if "aliases" in entities.columns:
        other = entities.select(F.explode("aliases").alias("alias"), F.col("id").alias("entity_id"), "seq").select(name_key(F.col("alias")).alias("name_key"), "entity_id", F.lit(True).alias("is_alias"), "seq")
        own = own.unionByName(other)
    first = F.min_by(F.struct("entity_id", "is_alias"), F.struct("is_alias", "seq", "entity_id")).alias("f")
    return own.filter("name_key != ''").groupBy("name_key").agg(first).select("name_key", "f.*")


def resolve(entities: DataFrame, wanted: str) -> DataFrame:
    """The live entity of this id, else of this name or alias; at most one row."""
    live = entities.filter("status != 'deleted'")
    by_id = live.filter(F.col("id") == wanted).withColumn("_tier", F.lit(0))
    key = name_key(F.lit(wanted))
    named = name_key(F.col("name")) == key
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: name_key(a) == key) if "aliases" in entities.columns else F.lit(False)
    by_name = live.filter(named | alias).withColumn("_tier", F.when(named, 1).otherwise(2))
    return by_id.unionByName(by_name).orderBy("_tier", "seq").limit(1).drop("_tier")


class Search:
    """One breadth-first search: all nodes met, and the frontier that was met last.

    A node keeps the first way it was met: least parent, edge position and label.
    """

    COLUMNS = ("id", "hop", "parent", "label", "via")

    def __init__(self, start: DataFrame, avoid: DataFrame | None = None, nodes: DataFrame | None = None) -> None:
        self.avoid, self.nodes = avoid, nodes  # ids that are never met, and the only ones that are
        none = F.lit(None).cast("string")
        self.frontier = stage(start.select(F.col("id"), F.lit(0).alias("hop"), none.alias("parent"), none.alias("label"), F.lit("").alias("via")).distinct(), "bfs")
        self.parts, self.hop, self.size = [self.frontier], 0, self.frontier.count()

    def seen(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def grow(self, edges: DataFrame) -> None:
        """Meet the neighbours of the frontier along ``src, dst, label, pos``."""
        self.hop += 1
        step = self.frontier.select(F.col("id").alias("src"), F.col("via").alias("_via")).join(edges, "src")
        met = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "pos", "label", "_via")).alias("f"))
        if self.avoid is not None:
            met = met.join(self.avoid, "id", "left_anti")
        if self.nodes is not None:
            met = met.join(self.nodes.select("id"), "id")
        via = F.when(F.col("f._via") == "", F.col("f.label")).otherwise(F.concat_ws(" -> ", "f._via", "f.label"))
        new = met.join(self.seen().select("id"), "id", "left_anti").select("id", F.lit(self.hop).alias("hop"), F.col("f.src").alias("parent"), F.col("f.label").alias("label"), via.alias("via"))
        self.frontier = stage(new, f"bfs-{self.hop}")
        self.parts.append(self.frontier)
        self.size = self.frontier.count()  # from the footers of what was just written

    def trace(self, node: str) -> list[tuple[str, str | None, str | None]]:
        """(node, parent, label) from a node back to the start: one lookup a hop."""
        out, at = [], node
        seen = self.seen()
        while at is not None:
            row = seen.filter(F.col("id") == at).select("parent", "label").first()
            out.append((at, row["parent"], row["label"]))
            at = row["parent"]
        return out


def expand(start: DataFrame, edges: DataFrame, hops: int, nodes: DataFrame | None = None) -> DataFrame:
    """``id, hop, parent, label, via`` of all nodes (of ``nodes``, if given) within ``hops`` of the ids of ``start``; cycles and self loops end at nodes already met."""
    held = edges.select("src", "dst", "label", F.col("pos").cast("bigint").alias("pos"))
    search = Search(start, nodes=nodes)
    for _ in range(hops):
        search.grow(held)
        if not search.size:
            break
    return search.seen().select(*Search.COLUMNS)


def impact(entities: DataFrame, edges: DataFrame, subject: str, *, depth: int = 2, kinds: list[str] | None = None, exclude_tests: bool = False, strict_depth: bool = False) -> DataFrame:
    """What depends on an entity: ``id, hop, via`` by reverse search over impact edges.

    ``depth`` is clamped to 1-4; nodes at ``depth`` are still expanded unless
    ``strict_depth``.  ``kinds`` narrows the edges that are followed, while
    ``exclude_tests`` only hides rows.  Deleted entities are no nodes; the
    subject itself is never a row; an unknown subject gives no rows.
    """
    depth = max(1, min(4, depth))
    use = [k for k in IMPACT_KINDS if kinds is None or k in kinds]
    live = entities.filter("status != 'deleted'").select("id", F.coalesce("file_path", F.lit("")).alias("file_path"))
    back = edges.filter(F.col("kind").isin(use)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("kind").alias("label"), "pos")
    found = expand(resolve(entities, subject).select("id"), back, depth + (0 if strict_depth else 1)).filter("hop > 0").join(live, "id")
    if exclude_tests:
        found = found.filter(~is_test_path(F.col("file_path")))
    return found.select("id", "hop", "via")


def hubs(edges: DataFrame, *, kind: str = "calls", least: int = HUB_CALLERS) -> DataFrame:
    """``id, n_in`` of nodes with many incoming edges of a kind."""
    return edges.filter(F.col("kind") == kind).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in")).filter(F.col("n_in") >= least)


def skip_nodes(entities: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """Ids that a path should not pass: exceptions, tests and hubs, but for ``keep``."""
    odd = entities.filter(is_exception_name(F.col("name")) | is_test_path(F.coalesce("file_path", F.lit("")))).select("id")
    return odd.union(hubs(edges).select("id")).distinct().filter(~F.col("id").isin(keep))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, reverse ones marked with "<" and behind forward ones."""
    kind = F.coalesce("kind", F.lit("related_to")).alias("label")
    turns = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), kind, F.col("pos").cast("bigint").alias("pos")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("<"), kind).alias("label"), (F.col("pos") + (1 << 31)).alias("pos")))
    return edges.select(F.inline(turns))


def shortest_path(entities: DataFrame, edges: DataFrame, start: str, end: str, *, max_hops: int = 6) -> DataFrame:
    """``step, id, relation, reverse, path_type`` along a shortest path, edges usable both ways.

    Tried in turn: semantic edges without the nodes of ``skip_nodes``, semantic
    edges, all edges without those nodes, all edges.  Equal ends give one row of
    step 0; no path gives no rows.
    """
    spark = entities.sparkSession
    max_hops = max(2, min(8, max_hops))
    ends = [resolve(entities, x).select("id").first() for x in (start, end)]
    schema = "step int, id string, relation string, reverse boolean, path_type string"
    if None in ends:
        return spark.createDataFrame([], schema)
    a, b = ends[0]["id"], ends[1]["id"]
    if a == b:
        return spark.createDataFrame([(0, a, None, None, "semantic")], schema)
    live = entities.filter("status != 'deleted'").select("id", "name", "file_path")
    skip = stage(skip_nodes(live, edges, [a, b]), "path-skip")
    semantic, ways = _both_ways(edges.filter(F.col("kind").isin(SEMANTIC_KINDS))), _both_ways(edges)
    nodes = live.select("id")
    some = not skip.isEmpty()
    tries = [(semantic, skip, "semantic", some), (semantic, None, "semantic", True), (ways, skip, "structural", some), (ways, None, "structural", True)]
    for use, avoid, name, wanted in tries:
        found = _meet(use, avoid, nodes, a, b, max_hops) if wanted else None
        if found:
            rows = [(i, node, label and label.lstrip("<"), label.startswith("<") if label else None, name) for i, (node, label) in enumerate(found)]
            return spark.createDataFrame(rows, schema)
    return spark.createDataFrame([], schema)


def _meet(ways: DataFrame, avoid: DataFrame | None, nodes: DataFrame, a: str, b: str, max_hops: int) -> list[tuple[str, str | None]] | None:
    """(node, label of the step to it) along a shortest path; None if there is none.

    Both ends search, the one with the smaller frontier going on, so a search
    that must fail ends as soon as either end is exhausted.
    """
    spark = ways.sparkSession
    ahead, behind = (Search(spark.createDataFrame([(x,)], "id string"), avoid, nodes) for x in (a, b))
    for _ in range(max_hops):
        side, other = (ahead, behind) if ahead.size <= behind.size else (behind, ahead)
        side.grow(ways)
        if not side.size:
            return None
        both = side.frontier.select("id", F.col("hop").alias("h1")).join(other.seen().select("id", F.col("hop").alias("h2")), "id")
        at = both.select("id", (F.col("h1") + F.col("h2")).alias("n")).orderBy("n", "id").first()
        if at:
            head = [(node, label) for node, _, label in reversed(ahead.trace(at["id"]))]
            # a step of the search from the end is walked the other way round
            turn = lambda label: label[1:] if label.startswith("<") else f"<{label}"
            return head + [(parent, turn(label)) for _, parent, label in behind.trace(at["id"]) if parent is not None]
    return None


def neighborhood(entities: DataFrame, edges: DataFrame, center: str, *, depth: int = 2, direction: str = "both", kinds: list[str] | None = None, max_nodes: int | None = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, hop``) and edges (``src, dst, kind``) around a node, for a diagram.

    ``max_nodes`` (5-150, None for all) keeps the nodes met first: a diagram of
    more cannot be read.  Edges to missing nodes are left out.
    """
    depth = max(1, min(4, depth))
    use = edges.filter(F.col("kind").isin(kinds or OUTBOUND_KINDS))
    live = entities.filter("status != 'deleted'").select("id")
    out = use.select("src", "dst", F.col("kind").alias("label"), F.col("pos").cast("bigint").alias("pos"))
    back = use.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("kind").alias("label"), (F.col("pos") + (1 << 31)).alias("pos"))
    ways = {"out": out, "in": back, "both": out.union(back)}[direction]
    nodes = expand(resolve(entities, center).select("id"), ways, depth, live).select("id", "hop")
    if max_nodes is not None:
        nodes = nodes.orderBy("hop", "id").limit(max(5, min(150, max_nodes)))
    ids = stage(nodes.select("id", "hop"), "neighborhood")
    inner = use.select("src", "dst", "kind").distinct().join(ids.select(F.col("id").alias("src"), F.col("hop").alias("h1")), "src").join(ids.select(F.col("id").alias("dst"), F.col("hop").alias("h2")), "dst")
    # an edge is met when one of its ends is expanded in its direction
    met = {"out": F.col("h1") < depth, "in": F.col("h2") < depth, "both": F.least("h1", "h2") < depth}[direction]
    return ids, inner.filter(met).select("src", "dst", "kind")


def diagram(nodes: DataFrame, edges: DataFrame, entities: DataFrame, *, form: str = "mermaid") -> DataFrame:
    """One row ``diagram``: Mermaid or DOT text of a small subgraph, in a fenced block."""
    node = lambda c: F.concat(F.lit("n"), F.regexp_replace(F.col(c), r"^ws_|\W", ""))
    label = F.regexp_replace(F.col("name"), '"', "'")
    named = nodes.join(entities.select("id", "name", "type"), "id")
    line = F.concat(F.lit("    "), node("id"), F.lit('["'), label, F.lit('"]')) if form == "mermaid" else F.concat(F.lit("    "), node("id"), F.lit(' [label="'), label, F.lit('"];'))
    arrow = F.concat(F.lit("    "), node("src"), F.lit(" -->|"), F.col("kind"), F.lit("| "), node("dst")) if form == "mermaid" else F.concat(F.lit("    "), node("src"), F.lit(" -> "), node("dst"), F.lit(' [label="'), F.col("kind"), F.lit('"];'))
    ordered = lambda df, text: df.select(text.alias("t")).agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("lines"))  # noqa: E731 - at most 150 nodes
    head, tail = ("```mermaid\ngraph TD", "```") if form == "mermaid" else ("```dot\ndigraph G {", "}\n```")
    a = ordered(named, line).withColumnRenamed("lines", "a")
    b = ordered(edges, arrow).withColumnRenamed("lines", "b")
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select(F.concat_ws("\n", F.lit(head), "a", "b", F.lit(tail)).alias("diagram"))


def editor_entry(entities: DataFrame) -> Column:
    """Classes that an editor or engine calls without a reference in code."""
    from loomgraph.functions.vocab import EDITOR_BASES, EDITOR_DECORATORS

    def last(column: str, cut: str) -> Column:
        each = F.split(F.coalesce(F.col(column), F.lit("")), ",")
        return F.transform(each, lambda x: F.element_at(F.split(F.split_part(F.trim(x), F.lit(cut), F.lit(1)), r"\."), -1))

    tests = []
    if "base_classes" in entities.columns:
        tests.append(F.arrays_overlap(last("base_classes", "<"), F.array(*map(F.lit, EDITOR_BASES))))
    if "decorators" in entities.columns:
        tests.append(F.arrays_overlap(last("decorators", "("), F.array(*map(F.lit, EDITOR_DECORATORS))))
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def orphans(entities: DataFrame, edges: DataFrame, *, types: list[str] | None = None, include_modules: bool = False) -> DataFrame:
    """Active entities that no impact edge points to and that nothing else explains: ``id, name, type, file_path``, to be ordered by type, name, id."""
    from loomgraph.functions.vocab import ENTRY_FILES, ENTRY_NAMES, VENDOR_DIRS

    live = entities.filter("status != 'deleted'")
    # edges of deleted entities don't count
    hit = edges.filter(F.col("kind").isin(IMPACT_KINDS)).join(live.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    rest = live.filter("status != 'stub'").join(hit, "id", "left_anti")
    if not include_modules:
        rest = rest.filter("type != 'module'")
    if types:
        rest = rest.filter(F.col("type").isin(types))
    path = F.translate(F.coalesce("file_path", F.lit("")), "\\", "/")
    explained = (
        F.lower("name").isin(ENTRY_NAMES) | F.col("name").rlike("^__[a-z_]+__$") | is_test_path(path)
        | path.rlike("(?:" + "|".join(f.replace(".", r"\.") for f in ENTRY_FILES) + ")$") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS))) | editor_entry(entities)
    )
    return rest.filter(~explained).select("id", "name", "type", "file_path")


def orphan_page(found: DataFrame, max_results: int = 100) -> DataFrame:
    """The first orphans by type, name and id, each with the ``total`` before the limit; the total is a count of its own, not a window over all rows."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy("type", "name", "id").limit(max_results)
    return page.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
