"""Modification counters kept up to date from a stream of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwarden.operators.skew import HOT_ROWS, lookup
from statwarden.sources import store

# Batches whose counts are kept apart; a reader meets at most so many, and one folder of all before them.
BATCHES_PER_GROUP = 64


def change_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Changes from the Parquet files of a folder, as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_end(
    changes: DataFrame, statistics: DataFrame, keys: Sequence[str], spread_by: str, folder: str, hot_rows: int = HOT_ROWS, batches_per_group: int = BATCHES_PER_GROUP
) -> None:
    """Counts, per batch, the changes later than the last refresh of each statistic and refresh epoch.

    ``statistics`` (keys, last_updated, epoch) is written once and read by every batch, also of
    a later call that goes on with the same folder. A refresh starts a new epoch. The counts
    of a batch go to a folder of its own, which a batch that is run again overwrites, so there is
    no state to keep or to expire. When a group of batches is full, its counts and those of
    all groups before are folded into one folder. A statistic with very many changes
    meets them in many tasks.
    """
    spark, keys = statistics.sparkSession, list(keys)
    if not store.is_complete(spark, f"{folder}/statistics"):
        statistics.select(*keys, "last_updated", "epoch").write.mode("overwrite").parquet(f"{folder}/statistics")

    def write(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.parquet(f"{folder}/statistics")
        group = batch_id // batches_per_group
        if batch_id % batches_per_group == 0 or not store.is_there(spark, f"{folder}/counts/group={group}"):
            # every earlier batch is complete once this one has begun
            for full in range(_last_folded(spark, folder) + 1, group):
                _fold(spark, folder, keys, full)
        since = lookup(batch, known, keys, [spread_by], how="inner", hot_rows=hot_rows).where(F.col("ts") > F.col("last_updated"))
        counts = since.groupBy(*keys, "epoch").agg(F.count(F.lit(1)).alias("counted"))
        counts.write.mode("overwrite").parquet(f"{folder}/counts/group={group}/batch_id={batch_id}")

    query = (
        changes.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def _last_folded(spark: SparkSession, folder: str) -> int:
    """The last group that is folded, -1 for none; groups are folded in order, so halving finds it."""

    def folded(group: int) -> bool:
        return store.is_complete(spark, f"{folder}/folded/group={group}")

    none = 1
    while folded(none - 1):
        none *= 2
    first, none = none // 2 - 1, none - 1
    while none - first > 1:
        middle = (first + none) // 2
        first, none = (middle, none) if folded(middle) else (first, middle)
    return first


def _totals(spark: SparkSession, folder: str, keys: list[str], folded: int) -> DataFrame:
    """Counts of all batches up to the group after ``folded``, out of one folder and that group's."""
    of_statistics = spark.read.parquet(f"{folder}/statistics").select(*keys, "epoch").schema
    schema = T.StructType([*of_statistics.fields, T.StructField("counted", T.LongType())])
    parts = spark.createDataFrame([], schema)
    for path in ([f"{folder}/folded/group={folded}"] if folded >= 0 else []) + [f"{folder}/counts/group={folded + 1}"]:
        if store.is_there(spark, path):
            parts = parts.unionByName(spark.read.schema(schema).parquet(path).select(*schema.names))
    return parts.groupBy(*keys, "epoch").agg(F.sum("counted").alias("counted"))


def _fold(spark: SparkSession, folder: str, keys: list[str], group: int) -> None:
    _totals(spark, folder, keys, group - 1).write.mode("overwrite").parquet(f"{folder}/folded/group={group}")


def current_counts(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The count of each statistic over all batches, 0 where no change came after its refresh.

    Reads the last folded group and the batches after it, however many came before;
    the batches of folded groups are not needed any more.
    """
    keys = list(keys)
    total = _totals(spark, folder, keys, _last_folded(spark, folder))
    return spark.read.parquet(f"{folder}/statistics").join(total, [*keys, "epoch"], "left").withColumn(
        "modification_counter", F.coalesce("counted", F.lit(0))
    ).drop("counted")
