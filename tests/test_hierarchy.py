import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.hierarchy import descendants, hierarchy


def brute(links):
    parent = {}
    for g, i, p in links:
        if i is None:
            continue
        old = parent.setdefault((g, i), p)
        if p is not None:
            parent[g, i] = p if old is None else min(old, p)
            parent.setdefault((g, p), None)
    out = {}
    for g, i in parent:
        path, at, seen = [i], parent[g, i], {i}
        while at is not None and at not in seen:
            path.append(at)
            seen.add(at)
            at = parent[g, at]
        if at is None:
            out[g, i] = ["tree", path[-1], len(path) - 1, 0, "/".join(path[::-1])]
        else:
            out[g, i] = ["cycle" if at == i else "below_cycle", "", -1, -1, ""]
    for (g, i), v in out.items():
        if v[0] == "tree":
            for a in v[4].split("/")[:-1]:
                out[g, a][3] += 1
    return {k: tuple(v) for k, v in out.items()}


def run(spark, links, schema="g string, id string, parent string"):
    df = hierarchy(spark.createDataFrame(links, schema), group=["g"])
    return df, {(r["g"], r["id"]): (r["state"], r["root"], r["depth"], r["n_desc"], r["path"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(rng.choice("ab"), f"n{i}", None if rng.random() < 0.1 else f"n{rng.randint(0, i + (2 if seed else 0))}") for i in range(120)]
    links += [links[0], links[5]]
    df, got = run(spark, links)
    assert got == brute(links)
    tree = [r for r in df.collect() if r["state"] == "tree"]
    by = {(r["g"], r["id"]): r for r in tree}
    pairs = {(r["g"], r["ancestor"], r["descendant"]) for r in descendants(df, F.lit(True), group=["g"]).collect()}
    assert pairs == {(r["g"], a, r["id"]) for r in tree for a in r["path"].split("/")[:-1]}
    assert all(by[g, a]["n_desc"] >= 1 for g, a, _ in pairs)


def test_long_chain_wide_node_and_cycles(spark):
    links = [("c", f"{i:04}", f"{i + 1:04}") for i in range(200)] + [("w", f"k{i}", "top") for i in range(500)]
    links += [("x", "a", "b"), ("x", "b", "c"), ("x", "c", "a"), ("x", "t", "a"), ("x", "u", "t"), ("x", "s", "s"), ("x", "r", None)]
    assert run(spark, links)[1] == brute(links)


def test_edges(spark):
    assert run(spark, [])[1] == {}
    links = [("g", None, "a"), ("g", "b", None), ("g", "b", None), (None, "z", None)]
    assert {k for k in run(spark, links)[1]} == {("g", "b"), (None, "z")}
    # a null group is a group like any other
    assert run(spark, [(None, "k", "top"), ("g", "k", "other")])[1] == {(None, "k"): ("tree", "top", 1, 0, "top/k"), (None, "top"): ("tree", "top", 0, 1, "top"), ("g", "k"): ("tree", "other", 1, 0, "other/k"), ("g", "other"): ("tree", "other", 0, 1, "other")}
    extra = [("g", "a", "b", 1, "x", 2, "y")]
    got = run(spark, extra, "g string, id string, parent string, depth int, path string, size int, state string")[1]
    assert got["g", "a"] == ("tree", "b", 1, 0, "b/a")
