"""Running totals over long ordered groups without a one-task window.

Each group is cut into buckets at sampled order values. Buckets are totalled
first (a hash aggregation), their offsets come from a window over the few bucket
totals, and only then does a window run inside each bucket. The cut points decide
how the work is spread, never the result. Sampling is by hash, so a re-run task
or a second reading of the same data sees the same cut points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a bucket; beyond 2**42 rows in all a bucket has 4 * sqrt(rows), so that there
# are at most sqrt(rows) / 4 cut points: 800,000 for the 1e13 values of 100 TB.
ROWS_PER_BUCKET = 1_000_000
# Bytes of texts of a bucket, as a million long texts are too many for a task; beyond 4 * 2**40 bytes
# in all a bucket has 16 * sqrt(bytes).
BYTES_PER_BUCKET = 1 << 25
# Cut points are pieces of texts: any value may part two buckets.
CUT_CHARACTERS = 64
HASH_RANGE = 1 << 30
# Ranges of numbers have a part of a bucket's rows, so that a few buckets still keep all cores busy.
RANGES_PER_BUCKET = 4
# A tie is cut again from this many buckets' rows on; of fewer rows a cut point may well miss it.
TIED_BUCKETS = 4
# Longest text that a common beginning is searched in, as a power of two.
LENGTH_BITS = 31


def _row_bytes(df: DataFrame, order: Sequence[str]) -> Column:
    """Bytes of a row's texts."""
    texts = [f.name for f in df.schema if f.name in order and isinstance(f.dataType, T.StringType)]
    return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(t), F.lit(0)) for t in texts], F.lit(0).cast("bigint"))


def _sizes(row_bytes: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("__n"), F.sum(row_bytes).alias("__bytes")]


def _cut_points(
    df: DataFrame, sizes: DataFrame, groups: list[str], key: Column, chosen_by: Column, rows_per_bucket: int, row_bytes: Column, bytes_per_bucket: int
) -> DataFrame:
    """Per group a sorted array of the keys of about rows / rows_per_bucket sampled rows, or bytes / bytes_per_bucket if these are more.

    Rows are sampled, not keys: a key of many rows is a cut point itself. A long text is the likelier one.
    """
    every = Window.partitionBy()
    per_bucket = F.greatest(F.lit(float(rows_per_bucket)), 4 * F.sqrt(F.sum("__n").over(every)))
    per_bytes = F.greatest(F.lit(float(bytes_per_bucket)), 16 * F.sqrt(F.sum("__bytes").over(every)))
    sizes = sizes.withColumns(
        {
            "__per": per_bucket if rows_per_bucket >= ROWS_PER_BUCKET else F.lit(float(rows_per_bucket)),
            "__per_bytes": per_bytes if bytes_per_bucket >= BYTES_PER_BUCKET else F.lit(float(bytes_per_bucket)),
        }
    )
    wanted = F.floor(F.col("__n") / F.col("__per"))
    sizes = sizes.select(
        *groups,
        (wanted / F.col("__n") * HASH_RANGE).cast("bigint").alias("__limit"),
        F.when(F.col("__bytes") >= F.col("__per_bytes"), HASH_RANGE / F.col("__per_bytes")).otherwise(0.0).alias("__byte_limit"),
    ).where("__limit > 0 OR __byte_limit > 0")
    limit = F.greatest(F.col("__limit"), (row_bytes * F.col("__byte_limit")).cast("bigint"))
    sampled = df.join(F.broadcast(sizes), groups).where(F.pmod(chosen_by, F.lit(HASH_RANGE)) < limit)
    cuts = sampled.groupBy(*groups).agg(F.sort_array(F.collect_set(key)).alias("__cuts"))
    last_bit = F.length(F.bin(F.size("__cuts"))) - 1
    jumps = F.transform(F.sequence(last_bit, F.lit(0), F.lit(-1)), lambda bit: F.call_function("shiftleft", F.lit(1), bit))
    return cuts.select(*groups, "__cuts", jumps.alias("__jumps"))


def _bucket(key: Column) -> Column:
    """Odd for a key that is a cut point, even for those between two: buckets ascend as keys do.

    A binary search: with so many cut points, looking at each would cost a row more the more rows there are.
    """

    def cut(number: Column) -> Column:
        return F.get("__cuts", number - 1)  # none beyond the last

    not_above = F.aggregate("__jumps", F.lit(0), lambda found, jump: F.when(cut(found + jump) <= key, found + jump).otherwise(found))
    # in a list of one, so that it is searched once
    bucket = F.transform(F.array(not_above), lambda n: F.when(n == 0, F.lit(0)).otherwise(2 * n - cut(n).eqNullSafe(key).cast("int")))
    return F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(F.get(bucket, F.lit(0)))


def _common_length(low: Column, high: Column) -> Column:
    """Characters that two texts begin with alike, found bit by bit."""

    def longer(length: Column, bit: Column) -> Column:
        more = length + F.call_function("shiftleft", F.lit(1), bit)
        alike = (more > 0) & (more <= F.length(low)) & low.startswith(F.substring(high, F.lit(1), more))
        return F.when(alike & (more <= F.length(high)), more).otherwise(length)

    return F.aggregate(F.sequence(F.lit(LENGTH_BITS - 1), F.lit(0), F.lit(-1)), F.lit(0), longer)


def _tie_cuts(
    placed: DataFrame, ties: DataFrame, groups: list[str], text: str, chosen_by: Column, rows_per_bucket: int, row_bytes: Column, bytes_per_bucket: int
) -> DataFrame:
    """Cut points inside each tie, and the length of what its texts have in common.

    The common beginning is skipped, so every level looks at characters that differ,
    however long the beginning is.
    """
    rows = placed.join(F.broadcast(ties.select(*groups)), groups)
    common = rows.groupBy(*groups).agg(_common_length(F.min(text), F.max(text)).alias("__skip"))
    skipped = rows.join(F.broadcast(common), groups)
    cuts = _cut_points(skipped, ties, groups, _next_characters(text), chosen_by, rows_per_bucket, row_bytes, bytes_per_bucket)
    return cuts.join(common, groups)


def _next_characters(text: str) -> Column:
    return F.substring(F.col(text), F.col("__skip") + 1, F.lit(CUT_CHARACTERS))


def rows_before(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    weight: str,
    result: str = "rows_before",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    folder: str | None = None,
    bytes_per_bucket: int = BYTES_PER_BUCKET,
) -> DataFrame:
    """Adds the sum of ``weight`` over all earlier rows of the same group.

    ``order`` must be unique within a group. Cut points are broadcast: all groups
    together have few, whatever their number (see ``ROWS_PER_BUCKET`` and ``BYTES_PER_BUCKET``). Texts are placed by
    their first characters. With a ``folder``, and a text as the last column of the order,
    large buckets of rows alike in these are cut again by the next characters that differ,
    level by level until none is left; the cut points are kept there, and ``df``,
    which every level reads, should be a written table. Without one such rows share a task.
    An order without texts needs no search with a ``folder``: Spark deals the rows out by ranges, which
    are short enough to be sampled whole, and each row is written with the number of its range.
    """
    spark, groups, order = df.sparkSession, list(groups), list(order)
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    key = F.struct(*[F.substring(o, 1, CUT_CHARACTERS).alias(o) if o in texts else F.col(o) for o in order])
    chosen_by, row_bytes = F.xxhash64(*order), _row_bytes(df, order)

    def kept(table: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return table
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    def finished(placed: DataFrame, levels: list[str]) -> DataFrame:
        # the place of a row is found once, and read for the totals and inside the bucket
        placed = kept(placed, "placed")
        totals = placed.groupBy(*groups, *levels).agg(F.sum(weight).alias("__sum"))
        earlier = Window.partitionBy(*groups).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*groups, *levels, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
        inside = Window.partitionBy(*groups, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        local = placed.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        return local.join(offsets, [*groups, *levels]).select(*df.columns, (F.col("__offset") + F.col("__local")).alias(result))

    if folder is not None and not texts.intersection(order):
        ranges = max(1, df.count() * RANGES_PER_BUCKET // rows_per_bucket)
        return finished(df.repartitionByRange(ranges, *groups, *order).withColumn("__range", F.spark_partition_id()), ["__range"])
    sizes = df.groupBy(*groups).agg(*_sizes(row_bytes))
    cuts = kept(_cut_points(df, sizes, groups, key, chosen_by, rows_per_bucket, row_bytes, bytes_per_bucket), "cuts_0")
    placed = df.join(F.broadcast(cuts), groups, "left").select(*df.columns, _bucket(key).alias("__bucket_0"))
    levels = ["__bucket_0"]
    while folder is not None and texts.intersection(order) == {order[-1]}:
        within = [*groups, *levels]
        # a row without a text has no equal, so only texts may be alike in a beginning and differ
        tied = placed.where((F.col(levels[-1]) % 2 == 1) & F.col(order[-1]).isNotNull())
        # at most rows / (TIED_BUCKETS * rows_per_bucket) ties and as many by bytes; a row alone cannot be parted
        many = (F.col("__n") >= TIED_BUCKETS * rows_per_bucket) | ((F.col("__n") > 1) & (F.col("__bytes") >= TIED_BUCKETS * bytes_per_bucket))
        counted = tied.groupBy(*within).agg(*_sizes(row_bytes)).where(many)
        ties = kept(counted, f"ties_{len(levels)}")
        if ties.isEmpty():
            break
        cuts = kept(_tie_cuts(placed, ties, within, order[-1], chosen_by, rows_per_bucket, row_bytes, bytes_per_bucket), f"cuts_{len(levels)}")
        levels.append(f"__bucket_{len(levels)}")
        deeper = _bucket(_next_characters(order[-1])).alias(levels[-1])
        placed = placed.join(F.broadcast(cuts), within, "left").select(*placed.columns, deeper)
    return finished(placed, levels)
