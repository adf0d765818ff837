import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import snapshot_diff as S

SCHEMA = "repo string, snap int, k string, at int, h string, size string"


def changed(old, new):
    return ~old("h").eqNullSafe(new("h"))


def run(spark, rows, log, schema=SCHEMA, **more):
    records = spark.createDataFrame(rows, schema)
    deliveries = spark.createDataFrame(log, "repo string, snap int")
    got = S.snapshot_diff(records, deliveries, scope=["repo"], version="snap", key="k", state=["h", "size"], order=["at"], modified=changed, **more)
    return sorted(map(tuple, got.select("repo", "snap", "k", "change").collect()))


def brute(rows, log):
    last = {}
    for repo, snap, k, at, h, size in rows:
        if None in (repo, snap, k):
            continue
        key = (repo, snap, k)
        # null states come first, as in Spark's order of structs
        rank = (at, h is not None, h or "", size is not None, size or "")
        if key not in last or rank > last[key][0]:
            last[key] = (rank, h)
    out = []
    by = {}
    for repo, snap in set(log):
        by.setdefault(repo, []).append(snap)
    for repo, snaps in by.items():
        snaps.sort()
        for a, b in zip(snaps, snaps[1:]):
            old = {k: v[1] for (r, s, k), v in last.items() if (r, s) == (repo, a)}
            new = {k: v[1] for (r, s, k), v in last.items() if (r, s) == (repo, b)}
            out += [(repo, b, k, "new") for k in new.keys() - old.keys()] + [(repo, b, k, "deleted") for k in old.keys() - new.keys()]
            out += [(repo, b, k, "modified") for k in old.keys() & new.keys() if old[k] != new[k]]
    return sorted(out)


def sample(n, seed, snaps=4):
    rng = random.Random(seed)
    rows = []
    for s in range(1, snaps + 1):
        for i in range(n):
            if rng.random() < 0.9:
                repo = "hot" if i % 3 == 0 else f"r{i % 5}"
                rows.append((repo, s, f"f{i}", rng.randint(0, 2), rng.choice(["a", "b", None]) if rng.random() < 0.2 else "a", str(rng.randint(0, 3)) if rng.random() < 0.1 else "1"))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
    log = [(r, s) for r in ("hot", "r0", "r1", "r2", "r3", "r4") for s in range(1, snaps + 1) if (r, s) != ("r1", 2)]
    return rows, log


def test_hash_equals_spark(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63, 50), rng.integers(-(2**63), 2**63, 50)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a bigint, b bigint")
    want = [r[0] for r in df.select(F.xxhash64("a", "b")).collect()]
    assert S.xx_longs(a, b).view(np.int64).tolist() == want


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 32, "width": 16}, {"bucket_rows": 4096, "width": 4, "max_width": 4}])
def test_equals_brute_force(spark, options):
    """Roomy tables, tables that must grow, and tables that never peel and are compared exactly."""
    rows, log = sample(300, 7)
    assert run(spark, rows, log, **options) == brute(rows, log)


def test_edges(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("r", 1, "a", 1, "x", "1")], []) == []
    rows = [(None, 1, "a", 1, "x", "1"), ("r", 1, None, 1, "x", "1"), ("r", 1, "a", 1, None, None), ("r", 1, "a", 1, None, None), ("r", 2, "a", None, None, None), ("r", 3, "", 1, "x" * 5000, "1")]
    log = [("r", 1), ("r", 2), ("r", 3), ("r", 3), ("gone", 1), ("gone", 2), (None, 4)]
    assert run(spark, rows, log) == [("r", 3, "", "new"), ("r", 3, "a", "deleted")]


def test_extra_columns_do_not_clash(spark):
    schema = SCHEMA + ", bucket int, kh string, fp int, cell int, n int, sign int, old int, new int, change string, ok int"
    rows = [("r", s, "a", 1, f"h{s}", "1", *[None] * 10) for s in (1, 2)]
    assert run(spark, rows, [("r", 1), ("r", 2)], schema) == [("r", 2, "a", "modified")]
