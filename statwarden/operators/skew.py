"""Attaching one row per key to a large side whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key holding at least this share of the rows is hot, so there are at most
# 1 / HOT_SHARE hot keys: their rows on the one-per-key side are always few
# enough to broadcast, whatever the size of the data.
HOT_SHARE = 0.001
# Below this many rows a key is no burden for one task.
HOT_ROWS = 1_000_000


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``left`` joined (left or inner) with ``right``, which has one row per key.

    Rows of hot keys get their match from a broadcast of the few hot ``right``
    rows and are dealt out row by row, over as many tasks as there are; all others meet their match
    in an ordinary shuffle join. The large side is shuffled once.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    sizes = left if sizes is None else sizes
    counts = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    # counted by itself: as a sum of the counts it would shuffle all keys once more
    total = sizes.agg(F.count(F.lit(1)).alias("__total"))
    hot = (
        counts.where(F.col("__rows") >= hot_rows)
        .crossJoin(F.broadcast(total))
        .where(F.col("__rows") >= F.col("__total") * HOT_SHARE)
        .select(*keys)
    )
    packed = right.select(*keys, F.struct(*payload, F.lit(True).alias("__found")).alias("__match"))
    hot_right = hot.join(packed, keys, "left").select(*keys, F.col("__match").alias("__hot"), F.lit(True).alias("__is_hot"))
    # odd, so never the 0 of the other rows
    spread = F.xxhash64(*spread_by).bitwiseOR(F.lit(1))
    tagged = left.join(F.broadcast(hot_right), keys, "left").withColumn(
        "__salt", F.when(F.col("__is_hot"), spread).otherwise(F.lit(0).cast("bigint"))
    )
    cold = packed.withColumn("__salt", F.lit(0).cast("bigint"))
    joined = tagged.join(cold, [*keys, "__salt"], "left").withColumn("__got", F.coalesce("__hot", "__match"))
    if how == "inner":
        joined = joined.where(F.col("__got.__found"))
    return joined.select("*", "__got.*").drop("__hot", "__is_hot", "__salt", "__match", "__got", "__found")


def keep(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], **options) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``, which has each key once."""
    return lookup(left, right.select(*keys), keys, spread_by, how="inner", **options)
