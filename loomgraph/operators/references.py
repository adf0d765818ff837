"""References to records that do not exist, are deleted, or came only later."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "full", "partial")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    *,
    on: dict[str, str],
    at: str | None = None,
    match: str = "simple",
    deleted: str | None = None,
    created: str | None = None,
    hot_from: int = 1_000_000,
) -> DataFrame:
    """Rows of ``refs`` whose target is ``missing``, ``deleted`` or ``late``, with the column ``reason``.

    ``on`` maps the columns of the (composite) foreign key to the columns of
    ``targets``.  References are grouped by their null mask and each mask is
    anti-joined on its non-null columns:

    * ``simple``  - a key with any null is no reference;
    * ``full``    - a wholly null key is no reference, a partly null one is ``missing``;
    * ``partial`` - a wholly null key is no reference, a partly null one needs a
      target that agrees on its non-null columns.

    ``deleted`` is a boolean SQL expression on ``targets``; ``created`` the
    column with the time a target came to exist, compared with ``at`` of the
    reference.  Several targets of one key count as one: it is deleted if all of
    them are, and exists from the earliest ``created`` of those that are not.  A
    null ``at`` or ``created`` is never late.  Repeated references stay repeated;
    extra columns of ``refs`` are kept, those of ``targets`` cannot clash.
    Empty ``targets`` make every reference ``missing``.

    Keys with ``hot_from`` references or more are split over one task for each
    ``hot_from`` of them, and their deduplicated target is repeated as often;
    all other keys stay whole.  There are at most references / ``hot_from`` of
    them, which bounds the broadcast that marks them.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    keys = list(on)
    if "reason" in refs.columns:
        raise ValueError("refs already has a column named reason")
    gone = F.coalesce(F.expr(deleted), F.lit(False)) if deleted else F.lit(False)
    base = targets.select(*[F.col(on[k]).alias(k) for k in keys], gone.alias("_gone"), (F.col(created) if created else F.lit(None).cast("timestamp")).alias("_created"))

    def by(mask_keys: list[str]) -> DataFrame:
        """One row per distinct target key: pre-aggregated, so hot targets don't multiply references."""
        return base.dropna(subset=mask_keys).groupBy(*mask_keys).agg(F.min("_gone").alias("_gone"), F.min(F.when(~F.col("_gone"), F.col("_created"))).alias("_created"))

    def judge(part: DataFrame, mask_keys: list[str]) -> DataFrame:
        hot = part.groupBy(*mask_keys).agg(F.floor(F.count(F.lit(1)) / F.lit(hot_from)).cast("int").alias("_salts")).filter("_salts > 0").withColumn("_salts", F.col("_salts") + 1)
        salts = F.coalesce("_salts", F.lit(1))
        part = part.join(F.broadcast(hot), mask_keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("_salts")
        existing = by(mask_keys).join(F.broadcast(hot), mask_keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        joined = part.join(existing.withColumn("_hit", F.lit(True)), [*mask_keys, "_salt"], "left")
        late = (F.col("_created") > F.col(at)) if at and created else F.lit(False)
        reason = F.when(F.col("_hit").isNull(), "missing").when(F.col("_gone"), "deleted").when(late, "late")
        return joined.withColumn("reason", reason).filter("reason is not null").select(*refs.columns, "reason")

    parts = []
    for mask in product((True, False), repeat=len(keys)):
        present = [k for k, there in zip(keys, mask) if there]
        if not present or (match == "simple" and len(present) < len(keys)):
            continue
        part = refs.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() if there else F.col(k).isNull() for k, there in zip(keys, mask))))
        if len(present) < len(keys) and match == "full":
            parts.append(part.withColumn("reason", F.lit("missing")))
        else:
            parts.append(judge(part, present))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, references: DataFrame, *, by: list[str]) -> DataFrame:
    """Orphans and references per table and period: ``by..., n_refs, n_orphans, rate``."""
    total = references.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    return total.join(bad, by, "left").select(*by, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), (F.coalesce("n_orphans", F.lit(0)) / F.col("n_refs")).alias("rate"))
