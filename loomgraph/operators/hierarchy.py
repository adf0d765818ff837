"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

Subtree sizes are computed upward, sibling preorder ranges are allocated by
prefix sums downward, and each node ends with a nested-set range
``[pre, pre + size)``: ``a`` is an ancestor of ``d`` exactly when they have the
same root and ``pre_a < pre_d < pre_a + size_a``.  Both directions run by
pointer doubling, so a tree of depth d takes about log2(d) rounds rather than d.
Upward, nodes are numbers: after round k a node knows its 2^k-th ancestor and
the number of descendants less than 2^k levels below.  Nodes whose pointer never
runs out have no root and go no further; the images of all those pointers shrink
to the cycles themselves.  Only nodes of trees take part downward, where ranges,
paths and depths are summed along the ancestors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import stage

SIBLING_SALTS = 64


def _sibling_offsets(nodes: DataFrame) -> DataFrame:
    """``n, off``: 1 + sizes of the siblings before each node (``n, jump, size``) that has a parent.

    Siblings are ordered by (salt, number) and summed in two steps, within a salt
    and over the at most SIBLING_SALTS salts of a parent, so a parent that holds
    a third of all rows is not one task.
    """
    kids = nodes.filter("jump is not null").select("n", "jump", "size", F.pmod(F.xxhash64("n"), F.lit(SIBLING_SALTS)).alias("salt"))
    salts = kids.groupBy("jump", "salt").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("jump").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salts.select("jump", "salt", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("jump", "salt").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return kids.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["jump", "salt"]).select("n", (F.lit(1) + F.col("base") + F.col("within")).alias("off"))


def _sizes(state: DataFrame, max_rounds: int) -> DataFrame:
    """``n, jump, low`` at the end of the upward rounds: ``jump`` is null and ``low`` the subtree size in trees, else ``jump`` lies on a cycle."""
    turning = None
    for k in range(max_rounds):
        below = state.filter("jump is not null").groupBy(F.col("jump").alias("n")).agg(F.sum("low").alias("more"))
        above = state.select(F.col("n").alias("jump"), F.col("jump").alias("jump2"))
        met = state.join(below, "n", "left").select("n", "jump", (F.col("low") + F.coalesce("more", F.lit(0))).alias("low"))
        state = stage(met.join(above, "jump", "left").select("n", F.col("jump2").alias("jump"), "low"), f"hierarchy-up{k}")
        left = state.filter("jump is not null").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("jump").alias("images")).first()
        # Done when every pointer left lies on a cycle for good: pointers of
        # equal images twice in a row map the image onto itself; tree nodes
        # still under way would shrink n.
        if left["n"] == 0 or turning == left:
            return state
        turning = left
    raise ValueError(f"not settled after {max_rounds} rounds")


def hierarchy(links: DataFrame, *, group: list[str], separator: str = "/", max_rounds: int = 40) -> DataFrame:
    """Every node with state, root, depth, path and nested-set range.

    ``links`` has the columns ``group..., id, parent``; a row names a node and
    its parent, null for none.  A node may come in several rows: of several
    parents the least id counts.  A parent that is no ``id`` of its group is
    taken as a node without a parent.  Null ids are no nodes; a node that is its
    own parent is a cycle; a null group is a group.  An empty table gives an
    empty result.

    Result, one row per node: ``group..., id, parent, state`` (``tree``,
    ``cycle``, ``below_cycle``), ``root, depth, n_desc, path, pre, size``.
    Without a root: root and path are '', depth, n_desc, pre and size are -1.
    """
    g = list(group)
    # a row names its node, and its parent as a node
    ends = F.array(F.struct(F.col("id").alias("id"), F.col("parent").alias("parent")), F.struct(F.col("parent").alias("id"), F.lit(None).cast(dict(links.dtypes)["parent"]).alias("parent")))
    named = links.filter("id is not null").select(*g, F.inline(ends)).filter("id is not null").groupBy(*g, "id").agg(F.min("parent").alias("parent"))
    nodes = stage(named.withColumn("n", F.monotonically_increasing_id()), "hierarchy-nodes")
    parents = nodes.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("id").alias("_id"), F.col("n").alias("jump"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g], F.col("parent") == F.col("_id"))
    links_up = stage(nodes.join(parents, same, "left").select("n", "jump"), "hierarchy-links")
    sized = _sizes(links_up.withColumn("low", F.lit(1).cast("bigint")), max_rounds)

    tree = stage(sized.filter("jump is null").select("n", F.col("low").alias("size")).join(links_up, "n").join(nodes.select("n", F.col("id").cast("string").alias("path"), F.col("id").alias("top")), "n"), "hierarchy-tree")
    # jump: 2^k-th ancestor; pre, path, depth: offsets, ids and levels from below it down to the node; top: the last ancestor known
    down = tree.join(_sibling_offsets(tree), "n", "left").select("n", "jump", "size", "top", F.lit(0).alias("depth"), "path", F.coalesce("off", F.lit(0)).alias("pre"))
    down = stage(down, "hierarchy-offsets")
    k = 0
    while not down.filter("jump is not null").isEmpty():
        above = down.select(F.col("n").alias("jump"), F.col("jump").alias("jump2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"), F.col("pre").alias("pre2"))
        went = F.col("jump").isNotNull()
        step = down.join(above, "jump", "left").select(
            "n",
            F.col("jump2").alias("jump"),
            "size",
            F.when(went, F.col("top2")).otherwise(F.col("top")).alias("top"),
            # a step over jump adds the levels up to it and those above it
            F.when(went, F.col("depth") + F.col("depth2") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(went, F.concat(F.col("path2"), F.lit(separator), F.col("path"))).otherwise(F.col("path")).alias("path"),
            (F.col("pre") + F.coalesce("pre2", F.lit(0))).alias("pre"),
        )
        down = stage(step, f"hierarchy-down{k}")
        k += 1

    ranged = down.select("n", F.lit("tree").alias("state"), F.col("top").alias("root"), "depth", (F.col("size") - 1).alias("n_desc"), "path", "pre", "size")
    minus = F.lit(-1).cast("bigint")
    rootless = sized.filter("jump is not null")
    cyclic = rootless.select(F.col("jump").alias("n")).distinct().withColumn("on_cycle", F.lit(True))
    loose = rootless.select("n").join(cyclic, "n", "left").select(
        "n", F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("state"), F.lit("").cast(dict(links.dtypes)["id"]).alias("root"), F.lit(-1).alias("depth"), minus.alias("n_desc"), F.lit("").alias("path"), minus.alias("pre"), minus.alias("size")
    )
    return nodes.join(ranged.unionByName(loose), "n").select(*g, "id", "parent", "state", "root", "depth", "n_desc", "path", "pre", "size")


def descendants(ranged: DataFrame, of: Column, *, group: list[str]) -> DataFrame:
    """All (ancestor, descendant) pairs of the ancestors chosen by ``of``, from the nested-set ranges."""
    tops = ranged.filter((F.col("state") == "tree") & of).select(*group, F.col("root"), F.col("id").alias("ancestor"), F.col("pre").alias("a_pre"), F.col("size").alias("a_size"))
    return (
        ranged.filter("state = 'tree'")
        .join(tops, [*group, "root"])
        .filter("pre > a_pre and pre < a_pre + a_size")
        .select(*group, "ancestor", F.col("id").alias("descendant"))
    )
