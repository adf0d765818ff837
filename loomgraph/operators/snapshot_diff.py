"""What changed between consecutive full snapshots, by set reconciliation.

Every snapshot is summarised once, as invertible Bloom lookup tables (IBLT): the
keys of a scope are split over hash buckets of at most ``bucket_rows`` keys, and
each bucket holds ``3 * width`` cells of (count, key xor, state xor, check xor).
Subtracting the tables of two snapshots cancels everything that did not change;
peeling the rest recovers the (key hash, state hash) pairs of the difference.
Only these are joined back to the records and classified, so the full records
are shuffled once, for picking the row that counts, whatever the number of
snapshots they are compared with.

Buckets that do not peel are summarised again with four times the width, and
each success is verified against an independent digest of the bucket.  What
would still not peel at the last width is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import stage

SLICE = 20  # bits of the element hash that choose one cell
HASHES = 3
DIGEST = -1  # pseudo cell with the digest of a bucket

# XXH64 as Spark defines it for a long; fixed values of the algorithm.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xx_longs(*columns: np.ndarray) -> np.ndarray:
    """``xxhash64(c1, c2, ...)`` of Spark for int64 columns, as uint64."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), 42, dtype=np.uint64)
        for c in columns:
            h = h + _P5 + np.uint64(8)
            h ^= _rotl(c.view(np.uint64) * _P2, 31) * _P1
            h = _rotl(h, 27) * _P1 + _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
    return h


def _cells(element: np.ndarray, width: int) -> list[np.ndarray]:
    mask = np.uint64((1 << SLICE) - 1)
    return [((element >> np.uint64(SLICE * j)) & mask).astype(np.int64) % width + j * width for j in range(HASHES)]


def peel(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Peel many buckets at once.

    ``cells`` has the shape (buckets, 3 * width + 1, 4): count, key xor, state
    xor, check xor; the last cell of a bucket is its digest.  Returns rows
    (bucket, key hash, state hash, sign) and a flag per bucket that says whether
    the whole difference came out and its digest agrees.
    """
    buckets, per = cells.shape[0], HASHES * width
    body = cells[:, :per, :].reshape(-1, 4).copy()
    digest = cells[:, per, :].copy()
    out = []
    look = np.flatnonzero(np.abs(body[:, 0]) == 1)
    while len(look):
        look = look[np.abs(body[look, 0]) == 1]
        key, state = body[look, 1], body[look, 2]
        pure = xx_longs(state, key).view(np.int64) == body[look, 3]
        look, key, state = look[pure], key[pure], state[pure]
        if not len(look):
            break
        element = xx_longs(key, state)
        bucket = look // per
        # one element may be pure in several of its cells: take it once
        _, first = np.unique(np.stack([bucket, element.view(np.int64)]), axis=1, return_index=True)
        look, key, state, element, bucket = look[first], key[first], state[first], element[first], bucket[first]
        sign = body[look, 0].copy()
        out.append(np.stack([bucket, key, state, sign], axis=1))
        check = xx_longs(state, key).view(np.int64)
        touched = []
        for at in _cells(element, width):
            at = at + bucket * per
            np.subtract.at(body[:, 0], at, sign)
            np.bitwise_xor.at(body[:, 1], at, key)
            np.bitwise_xor.at(body[:, 2], at, state)
            np.bitwise_xor.at(body[:, 3], at, check)
            touched.append(at)
        np.subtract.at(digest[:, 0], bucket, sign)
        np.bitwise_xor.at(digest[:, 3], bucket, xx_longs(state, key, np.zeros_like(key)).view(np.int64))
        look = np.unique(np.concatenate(touched))
    found = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
    empty = ~body.reshape(buckets, per * 4).any(axis=1)
    return found, empty & (digest[:, 0] == 0) & (digest[:, 3] == 0)


def _sketch(records: DataFrame, scope: list[str], version: str, width: int) -> DataFrame:
    """IBLT cells of every (scope, version, bucket); sparse, pre-aggregated map-side."""
    element = F.xxhash64("kh", "fp")
    mask = (1 << SLICE) - 1
    one = [
        F.struct(
            (F.pmod(F.shiftrightunsigned(element, SLICE * j).bitwiseAND(F.lit(mask)), F.lit(width)) + j * width).cast("int").alias("cell"),
            F.xxhash64("fp", "kh").alias("check"),
        )
        for j in range(HASHES)
    ]
    digest = F.struct(F.lit(DIGEST).alias("cell"), F.xxhash64("fp", "kh", F.lit(0).cast("bigint")).alias("check"))
    return (
        records.select(*scope, version, "bucket", "kh", "fp", F.explode(F.array(*one, digest)).alias("at"))
        .groupBy(*scope, version, "bucket", F.col("at.cell").alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("fp").alias("fx"), F.bit_xor("at.check").alias("cx"))
    )


def _peel_udf(scope: list[str], width: int, chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per = HASHES * width
        for whole in batches:
            for at in range(0, len(whole), chunk):
                part = whole.iloc[at : at + chunk].reset_index(drop=True)
                cells = np.zeros((len(part), per + 1, 4), dtype=np.int64)
                for i, (c, n, kx, fx, cx) in enumerate(zip(part["cell"], part["n"], part["kx"], part["fx"], part["cx"])):
                    cells[i, np.asarray(c), :] = np.stack([n, kx, fx, cx], axis=1)  # DIGEST is the last one
                found, ok = peel(cells, width)
                rows = part.loc[found[:, 0], [*scope, "to_version", "bucket"]].reset_index(drop=True)
                rows["kh"], rows["ok"] = found[:, 1], True
                bad = part.loc[~ok, [*scope, "to_version", "bucket"]].assign(kh=0, ok=False)
                rows = rows[ok[found[:, 0]]]
                yield pd.concat([rows, bad], ignore_index=True)

    return run


def snapshot_diff(
    records: DataFrame,
    deliveries: DataFrame,
    *,
    scope: list[str],
    version: str,
    key: str,
    state: list[str],
    order: list[str],
    modified: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    deliveries_scope: list[str] | None = None,
    bucket_rows: int = 2048,
    width: int = 256,
    max_width: int = 1 << 14,
) -> DataFrame:
    """Added, changed and removed records between consecutive delivered snapshots.

    ``records`` has one row per delivered record (repeated and superseded rows
    allowed): of several rows of a (scope, version, key) the greatest by
    ``order`` counts, ties going to the greatest state.  ``deliveries`` lists
    the delivered (``deliveries_scope``, version) pairs; a version of a scope
    that is not listed was never delivered and its rows are ignored.  ``state``
    are the columns that may change; ``modified(old, new)`` gets two accessors
    of them and says whether a change counts, null meaning no.

    Result: ``scope..., version, key, change`` (``new``/``deleted``/``modified``),
    one row per changed record, ``version`` being the later one.  Rows with a
    null key, scope or version are no records.  Empty tables give an empty
    result; other columns are ignored.
    """
    on = deliveries_scope or scope
    names = [*scope, version, key]
    latest = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in state])).alias("last")
    counted = (
        records.select(*names, *order, *state)
        .dropna(subset=names)
        .groupBy(*names)
        .agg(latest)
        .select(
            *names,
            *[F.col(f"last.{c}").alias(c) for c in state],
            F.xxhash64(key).alias("kh"),
            # every value with its null flag, so that (null, x) and (x, null) differ
            F.xxhash64(key, *[v for c in state for v in (F.col(f"last.{c}").isNull(), F.col(f"last.{c}"))]).alias("fp"),
        )
    )
    kept = stage(counted, "snapshot-records")
    size = kept.groupBy(*scope, version).count().groupBy(*scope).agg(F.ceil(F.max("count") / bucket_rows).cast("bigint").alias("buckets"))
    placed = kept.join(size, scope).withColumn("bucket", F.pmod(F.shiftright("kh", 13), F.col("buckets"))).drop("buckets")
    w = Window.partitionBy(*on).orderBy(version)
    pairs = (
        deliveries.select(*on, version).dropna().distinct().withColumn("from_version", F.lag(version).over(w)).dropna().withColumnRenamed(version, "to_version")
    )
    # each snapshot is the later one of a pair and the earlier one of the next
    sides = pairs.select(*on, "to_version", F.explode(F.array(F.struct(F.col("to_version").alias(version), F.lit(1).alias("sign")), F.struct(F.col("from_version").alias(version), F.lit(-1).alias("sign")))).alias("side")).select(*on, "to_version", "side.*")
    sides = stage(sides, "snapshot-pairs")

    where = [*scope, "to_version", "bucket"]
    shape = records.select(*scope).schema.simpleString()[7:-1] + f", to_version {dict(records.dtypes)[version]}, bucket bigint, kh bigint, ok boolean"
    found, todo = [], None
    while True:
        source = placed if todo is None else placed.join(todo.select(*scope, "bucket").distinct(), [*scope, "bucket"], "left_semi")
        diff = (
            _sketch(source, scope, version, width)
            .join(sides, [*on, version])
            .groupBy(*where, "cell")
            .agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.bit_xor("kx").alias("kx"), F.bit_xor("fx").alias("fx"), F.bit_xor("cx").alias("cx"))
            .filter("n != 0 or kx != 0 or fx != 0 or cx != 0")
        )
        if todo is not None:
            diff = diff.join(todo, where, "left_semi")
        # at most 3 * width + 1 cells a bucket, by construction
        parts = ("cell", "n", "kx", "fx", "cx")
        grouped = diff.groupBy(*where).agg(F.collect_list(F.struct(*parts)).alias("cells")).select(*where, *[F.col(f"cells.{c}").alias(c) for c in parts])
        got = stage(grouped.mapInPandas(_peel_udf(scope, width, max(1, (1 << 18) // width // 4)), shape), "snapshot-peeled")
        found.append(got.filter("ok").select(*scope, "to_version", "kh"))
        todo = got.filter("not ok").select(*where)
        if todo.isEmpty():
            break
        if width >= max_width:
            # exact comparison of what is left: all keys of these buckets are candidates
            found.append(placed.join(sides, [*on, version]).join(todo, where, "left_semi").select(*scope, "to_version", "kh"))
            break
        width = min(width * 4, max_width)
    keys = found[0]
    for more in found[1:]:
        keys = keys.union(more)
    keys = keys.distinct()

    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    held = F.struct(F.lit(1).alias("there"), *state)
    return (
        keys.join(sides, [*on, "to_version"])
        .join(kept, [*scope, version, "kh"])
        .groupBy(*scope, "to_version", key)
        .agg(F.max(F.when(F.col("sign") < 0, held)).alias("old"), F.max(F.when(F.col("sign") > 0, held)).alias("new"))
        .withColumn("change", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(modified(old, new), "modified"))
        .filter("change is not null")
        .select(*scope, F.col("to_version").alias(version), key, "change")
    )
