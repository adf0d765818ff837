"""Graph queries over a property graph derived from the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import name_key
from loomgraph.functions.vocab import OUTBOUND_KINDS
from loomgraph.operators import graph, search
from loomgraph.session import table

NODE_TABLES = {
    "region": ("R", "r_regionkey", "r_name", ()),
    "nation": ("N", "n_nationkey", "n_name", ()),
    "customer": ("C", "c_custkey", "c_name", ("c_mktsegment",)),
    "supplier": ("S", "s_suppkey", "s_name", ()),
    "part": ("P", "p_partkey", "p_name", ("p_brand", "p_type")),
    "order": ("O", "o_orderkey", None, ("o_orderpriority", "o_orderstatus")),
}
EDGE_TABLES = [
    ("nation", "part_of", "N", "n_nationkey", "R", "n_regionkey"),
    ("customer", "depends_on", "C", "c_custkey", "N", "c_nationkey"),
    ("supplier", "depends_on", "S", "s_suppkey", "N", "s_nationkey"),
    ("orders", "calls", "O", "o_orderkey", "C", "o_custkey"),
    ("lineitem", "uses", "O", "l_orderkey", "P", "l_partkey"),
    ("lineitem", "imports", "O", "l_orderkey", "S", "l_suppkey"),
]


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, (prefix, key, name, text) in NODE_TABLES.items():
        rows = table(spark, sf_dir, "orders" if kind == "order" else kind)
        label = F.col(name) if name else _id(prefix, key)
        parts.append(
            rows.select(
                _id(prefix, key).alias("id"), F.col(key).cast("bigint").alias("seq"), F.lit(kind).alias("type"), label.alias("name"), name_key(label).alias("name_key"),
                F.lit("active").alias("status"), F.concat_ws(" ", *text).alias("summary") if text else F.lit("").alias("summary"), F.lit("").alias("file_path"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, *, unique: bool = True) -> DataFrame:
    """All edges; a traversal meets a node once however often it is told to, so it can do without ``unique``."""
    parts = [table(spark, sf_dir, t).select(_id(a, x).alias("src"), F.lit(k).alias("kind"), _id(b, y).alias("dst")) for t, k, a, x, b, y in EDGE_TABLES]
    # one edge per (source, kind, target): only lineitem repeats
    parts = [p.distinct() if unique and t[0] == "lineitem" else p for p, t in zip(parts, EDGE_TABLES)]
    return reduce(DataFrame.unionByName, parts).withColumn("pos", F.lit(0)).withColumn("note", F.lit(None).cast("string"))




def impact_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on a region, part_of counting as dependence."""
    e = edges(spark, sf_dir, unique=False).withColumn("kind", F.when(F.col("kind") == "part_of", "depends_on").otherwise(F.col("kind")))
    return graph.impact(nodes(spark, sf_dir), e, "R:0", depth=4).select("id", "hop")


def impact_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(nodes(spark, sf_dir), edges(spark, sf_dir, unique=False), "P:7", depth=2, kinds=["uses"], strict_depth=True).select("id", "hop", "via")


def path_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of a shortest path, structural edges allowed, and whether each of its steps is an edge."""
    found = graph.shortest_path(nodes(spark, sf_dir), edges(spark, sf_dir, unique=False), "C:0", "S:5")
    steps = found.alias("a").join(found.alias("b"), F.col("b.step") == F.col("a.step") + 1)
    turned = F.col("b.reverse")
    steps = steps.select(F.when(turned, F.col("b.id")).otherwise(F.col("a.id")).alias("src"), F.col("b.relation").alias("kind"), F.when(turned, F.col("a.id")).otherwise(F.col("b.id")).alias("dst"))
    real = steps.join(edges(spark, sf_dir, unique=False).select("src", "kind", "dst"), ["src", "kind", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("n_edges"))
    length = found.agg(F.max("step").alias("length"), F.first("path_type").alias("path_type"), F.min_by("id", "step").alias("first_id"), F.max_by("id", "step").alias("last_id"))
    return length.withColumn("_k", F.lit(1)).join(real.withColumn("_k", F.lit(1)), "_k").drop("_k")


def neighborhood_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _ = graph.neighborhood(nodes(spark, sf_dir), edges(spark, sf_dir, unique=False), "N:3", depth=2, direction="in", kinds=["depends_on", "calls"], max_nodes=None)
    return ids.select("id", "hop")


def diagram_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    ids, inner = graph.neighborhood(n, e, "R:1", depth=1, direction="in", kinds=["part_of"])
    return graph.diagram(ids, inner, n)


def hub_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(edges(spark, sf_dir))


def orphan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whom no urgent order calls."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(_id("O", "o_orderkey").alias("src"))
    e = edges(spark, sf_dir).filter("kind = 'calls'").join(urgent, "src", "left_semi")
    return graph.orphans(nodes(spark, sf_dir), e, types=["customer"]).select("id", "name")


def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a line of 48 or more."""
    e = table(spark, sf_dir, "lineitem").filter("l_quantity >= 48").select(_id("O", "l_orderkey").alias("src"), F.lit("uses").alias("kind"), _id("P", "l_partkey").alias("dst"), F.lit(0).alias("pos"))
    return graph.orphans(nodes(spark, sf_dir), e, types=["part"]).select("id", "name")


def find_part_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).filter("type = 'part'")
    word = n.orderBy("seq").select(F.element_at(F.split("name", " "), -1)).first()[0]
    return search.find(n, word, max_results=20).select("id", "tier")


def find_callers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).filter("type = 'customer'").select("id")
    return search.callers(n, edges(spark, sf_dir).filter("kind = 'calls'")).select("id", "caller", "rank")


def callees_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first twelve relations of each order, by kind and target, those of an outbound kind."""
    e = edges(spark, sf_dir).filter("src like 'O:%'")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("kind", "dst")) - 1)
    n = nodes(spark, sf_dir).filter("type = 'order'").select("id")
    return search.callees(n, e).select("id", "callee", "via")


def context_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored parts for a text, in twentieths."""
    n = nodes(spark, sf_dir).filter("type = 'part'")
    return search.context(n, edges(spark, sf_dir), "brand small steel", max_seeds=20, hops=0).select("id", "score")


def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stats_by_type(nodes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (impact_region, impact_part, path_customer_supplier, neighborhood_nation, diagram_region, hub_customers, orphan_customers, orphan_parts, find_part_tiers, find_callers_topk, callees_orders, context_parts, stats_by_type)}

_NODES = " UNION ALL ".join(
    f"SELECT '{p}:' || {k} AS id, CAST({k} AS BIGINT) AS seq, '{t}' AS type, {n or f"'{p}:' || {k}"} AS name, {' || '.join(f"{x}" if i == 0 else f"' ' || {x}" for i, x in enumerate(s)) or "''"} AS summary FROM {'orders' if t == 'order' else t}"
    for t, (p, k, n, s) in NODE_TABLES.items()
)
_EDGES = " UNION ".join(f"SELECT '{a}:' || {x} AS src, '{k}' AS kind, '{b}:' || {y} AS dst FROM {t}" for t, k, a, x, b, y in EDGE_TABLES)
_OUT = ", ".join(f"'{k}'" for k in OUTBOUND_KINDS)
_HEAD = f"node AS ({_NODES}), edge AS ({_EDGES})"


def _bfs(start: str, step: str, hops: int) -> str:
    return f"WITH RECURSIVE {_HEAD}, b AS (SELECT '{start}' AS id, 0 AS hop UNION SELECT {step}, b.hop + 1 FROM b JOIN e ON e.dst = b.id WHERE b.hop < {hops})"


ORACLES = {
    "impact_region": _bfs("R:0", "e.src", 5).replace(", b AS", ", e AS MATERIALIZED (SELECT * FROM edge WHERE kind IN ('calls', 'imports', 'depends_on', 'uses', 'part_of')), b AS", 1) + " SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY id HAVING min(hop) > 0",
    "impact_part": f"WITH {_HEAD} SELECT src AS id, 1 AS hop, 'uses' AS via FROM edge WHERE kind = 'uses' AND dst = 'P:7'",
    "path_customer_supplier": f"""WITH RECURSIVE {_HEAD}, u AS MATERIALIZED (SELECT src AS a, dst AS b, kind FROM edge UNION ALL SELECT dst, src, kind FROM edge),
w AS (SELECT 'C:0' AS id, 0 AS hop UNION SELECT u.b, w.hop + 1 FROM w JOIN u ON u.a = w.id WHERE w.hop < 6 AND u.kind IN ('calls', 'uses')),
x AS (SELECT 'C:0' AS id, 0 AS hop UNION SELECT u.b, x.hop + 1 FROM x JOIN u ON u.a = x.id WHERE x.hop < 4)
SELECT CAST(coalesce(s, t) AS INTEGER) AS length, CASE WHEN s IS NULL THEN 'structural' ELSE 'semantic' END AS path_type, 'C:0' AS first_id, 'S:5' AS last_id, CAST(coalesce(s, t) AS BIGINT) AS n_edges
FROM (SELECT (SELECT min(hop) FROM w WHERE id = 'S:5') AS s, (SELECT min(hop) FROM x WHERE id = 'S:5') AS t)""",
    "neighborhood_nation": _bfs("N:3", "e.src", 2).replace(", b AS", ", e AS MATERIALIZED (SELECT * FROM edge WHERE kind IN ('depends_on', 'calls')), b AS", 1) + " SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY id",
    "diagram_region": """WITH a AS (SELECT 'nR1' AS k, r_name AS n FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nN' || n_nationkey, n_name FROM nation WHERE n_regionkey = 1)
SELECT '```mermaid' || chr(10) || 'graph TD' || chr(10) || (SELECT string_agg(t, chr(10) ORDER BY t) FROM (SELECT '    ' || k || '["' || n || '"]' AS t FROM a)) || chr(10)
|| (SELECT string_agg(t, chr(10) ORDER BY t) FROM (SELECT '    ' || k || ' -->|part_of| nR1' AS t FROM a WHERE k <> 'nR1')) || chr(10) || '```' AS diagram""",
    "hub_customers": f"WITH {_HEAD} SELECT dst AS id, count(*) AS n_in FROM edge WHERE kind = 'calls' GROUP BY dst HAVING count(*) >= 20",
    "orphan_customers": "SELECT 'C:' || c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "orphan_parts": "SELECT 'P:' || p_partkey AS id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48)",
    "find_part_tiers": """WITH w AS (SELECT lower(string_split(p_name, ' ')[-1]) AS w FROM part ORDER BY p_partkey LIMIT 1),
t AS (SELECT p_partkey, CASE WHEN lower(p_name) = w THEN 0 WHEN lower(p_name) LIKE '%.' || w OR lower(p_name) LIKE '%$_' || w ESCAPE '$' THEN 1 WHEN contains(lower(p_name), w) THEN 2 END AS tier FROM part, w)
SELECT 'P:' || p_partkey AS id, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, p_partkey LIMIT 20""",
    "find_callers_topk": """WITH r AS (SELECT 'C:' || o_custkey AS id, 'O:' || o_orderkey AS caller, row_number() OVER (PARTITION BY o_custkey ORDER BY 'O:' || o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT id, caller, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""",
    "callees_orders": f"WITH {_HEAD}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY kind, dst) AS n FROM edge WHERE src LIKE 'O:%') SELECT src AS id, dst AS callee, kind AS via FROM r WHERE n <= 12 AND kind IN ({_OUT})",
    "context_parts": "WITH s AS (SELECT p_partkey, "
    + " + ".join(
        f"CASE WHEN lower(p_name) = '{t}' THEN 20 WHEN contains(lower(p_name), '{t}') THEN 14 ELSE 0 END + CASE WHEN contains(lower(p_brand || ' ' || p_type), '{t}') THEN 8 ELSE 0 END"
        for t in ("brand", "small", "steel")
    )
    + " AS score FROM part) SELECT 'P:' || p_partkey AS id, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20",
    "stats_by_type": f"WITH {_HEAD} SELECT type, count(*) AS n, CAST(0 AS BIGINT) AS n_stubs FROM node GROUP BY type",
}
