"""Ordered work over groups of any size: top-k, carried values, steps.

A plain window puts a whole group in one task. These helpers split a group first, so a
group holding a third of all rows is still spread over the cluster, and give the same
rows as the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
    salt_on: Sequence[str] | None = None,
) -> DataFrame:
    """The first `k` rows per group, exact: k per salted part of a group, then k of those."""
    # A part of a group per shuffle partition: a hot group spreads over all of them.
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*(salt_on or df.columns)), F.lit(salts))
    parts = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    near = (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(parts))
        .filter(F.col("_rn") <= k)
        .drop("_salt")
    )
    ranked = near.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= k)
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")


def _matching(left: DataFrame, right: DataFrame, columns: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"{prefix}{c}"])
    return out


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[str],
    value: Column,
    name: str,
    include_current: bool = False,
) -> DataFrame:
    """Add the last non-null `value` before each row of its group.

    `blocks` cut a group into runs that follow `order`, coarse to fine: month and day;
    directory, file and ordinal range. Windows run inside the finest run. Each run then
    counts as one row of the run above it, and so on up to the group, so no window holds
    more rows than one run has parts.
    """
    depth = len(blocks)
    own, near_name, up, prefix = (f"_{x}{depth}" for x in ("value", "near", "carried", "key"))
    runs = [f"_run{depth}_{i}" for i in range(depth)]
    end = 0 if include_current else -1
    inside = W.partitionBy(*keys, *runs).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    cut = df.withColumns({**dict(zip(runs, blocks)), own: value})
    near = cut.withColumn(near_name, F.last(own, ignorenulls=True).over(inside))
    if not blocks:
        return near.withColumnRenamed(near_name, name).drop(own)

    present = F.when(F.col(own).isNotNull(), F.struct(*order))
    last = cut.groupBy(*keys, *runs).agg(F.max_by(own, present).alias("_last"))
    above = with_previous(
        last, keys, [F.col(r) for r in runs[:-1]], [runs[-1]], F.col("_last"), up
    )
    carried = above.select(*[F.col(c).alias(f"{prefix}{c}") for c in [*keys, *runs]], up)
    joined = near.join(carried, _matching(near, carried, [*keys, *runs], prefix), "left")
    return joined.withColumn(name, F.coalesce(near_name, up)).drop(
        *runs, own, near_name, up, *[f"{prefix}{c}" for c in [*keys, *runs]]
    )
