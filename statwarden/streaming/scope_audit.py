"""Audit of scope changes that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwarden.operators import scope
from statwarden.sources import store
from statwarden.streaming.modifications import BATCHES_PER_GROUP, _last_folded

CHANGE = ["seq", "deleted", "configured_name", *scope.SCOPE_FIELDS]
# A change may come after others that are up to so many sequence numbers further on.
LATENESS = 100_000
NO_MARK = -(2**63)


def run_to_end(changes: DataFrame, folder: str, lateness: int = LATENESS, batches_per_group: int = BATCHES_PER_GROUP) -> None:
    """Takes in change rows (seq, deleted, scope columns), batch by batch.

    When a group of batches is full, its changes up to a mark, ``lateness`` numbers before the
    highest one seen, are closed: each becomes a step from the state before it, and the last state per
    entry is all that later steps need. Changes after the mark stay open, so until they are closed
    they may come in any order and cut into any batches. One that comes below the mark is late:
    it makes no step and is listed by ``late_changes``. Batches and folds that are run
    again after a failure overwrite their own folders only.
    """
    spark = changes.sparkSession
    schema = _typed(changes.select(*CHANGE).schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        group = batch_id // batches_per_group
        if batch_id % batches_per_group == 0 or not store.is_there(spark, f"{folder}/log/group={group}"):
            # every earlier batch is complete once this one has begun
            for full in range(_last_folded(spark, folder) + 1, group):
                _fold(spark, folder, schema, full, lateness)
        late = F.col("seq") <= F.lit(_mark(spark, folder, group - 1))
        batch.select(*_cast(schema), late.alias("late")).write.mode("overwrite").parquet(f"{folder}/log/group={group}/batch_id={batch_id}")

    query = (
        changes.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def _typed(schema: T.StructType) -> T.StructType:
    """The columns of a change, its number as a long, all nullable."""
    return T.StructType([T.StructField(n, T.LongType() if n == "seq" else schema[n].dataType) for n in CHANGE])


def _cast(schema: T.StructType) -> list:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]


def _state_schema(schema: T.StructType) -> T.StructType:
    state = T.StructType([schema[n] for n in scope.SCOPE_FIELDS])
    return T.StructType([schema["configured_name"], schema["seq"], T.StructField("state", state)])


def _step_schema(schema: T.StructType) -> T.StructType:
    state = _state_schema(schema)["state"].dataType
    fields = [schema["configured_name"], schema["seq"], T.StructField("new", state), T.StructField("old", state), T.StructField("first", T.BooleanType())]
    return T.StructType(fields)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if store.is_there(spark, path) else spark.createDataFrame([], schema)


def _mark(spark: SparkSession, folder: str, group: int) -> int:
    """The number up to which changes are closed after ``group``."""
    return spark.read.parquet(f"{folder}/folded/group={group}").first().mark if group >= 0 else NO_MARK


def _log(spark: SparkSession, folder: str, schema: T.StructType, group: int, late: bool) -> DataFrame:
    rows = _read(spark, f"{folder}/log/group={group}", T.StructType([*schema.fields, T.StructField("late", T.BooleanType())]))
    return rows.where(F.col("late") == F.lit(late)).select(*schema.names)


def _not_closed(spark: SparkSession, folder: str, schema: T.StructType, folded: int) -> DataFrame:
    """States after the mark: what the last fold left open and the batches after it."""
    rows = _read(spark, f"{folder}/open/group={folded}", schema).unionByName(_log(spark, folder, schema, folded + 1, late=False))
    return rows.select("configured_name", "seq", F.when(~F.col("deleted"), F.struct(*scope.SCOPE_FIELDS)).alias("state"))


def _steps(base: DataFrame, states: DataFrame) -> DataFrame:
    """Each state with the one before it; ``first`` where the stream has none before it."""
    order = Window.partitionBy("configured_name").orderBy("seq")
    touched = base.join(states.select("configured_name").distinct(), "configured_name", "left_semi")
    every = states.withColumn("fresh", F.lit(True)).unionByName(touched.withColumn("fresh", F.lit(False)))
    before = F.lag(F.struct("state")).over(order)
    steps = every.select("configured_name", "seq", F.col("state").alias("new"), before.alias("before"), "fresh").where("fresh")
    return steps.select("configured_name", "seq", "new", F.col("before.state").alias("old"), F.col("before").isNull().alias("first"))


def _last(states: DataFrame) -> DataFrame:
    last = states.groupBy("configured_name").agg(F.max_by(F.struct("seq", "state"), "seq").alias("last"))
    return last.select("configured_name", "last.seq", "last.state")


def _fold(spark: SparkSession, folder: str, schema: T.StructType, group: int, lateness: int) -> None:
    """Closes the changes up to the new mark; the mark is written last and makes the fold count."""
    base = _read(spark, f"{folder}/base/group={group - 1}", _state_schema(schema))
    states = _not_closed(spark, folder, schema, group - 1)
    highest = states.agg(F.max("seq").alias("seq")).first().seq
    before = _mark(spark, folder, group - 1)
    mark = before if highest is None else max(before, highest - lateness)
    closed = states.where(F.col("seq") <= F.lit(mark))
    _steps(base, closed).write.mode("overwrite").parquet(f"{folder}/steps/group={group}")
    _last(base.unionByName(closed)).write.mode("overwrite").parquet(f"{folder}/base/group={group}")
    rows = states.where(F.col("seq") > F.lit(mark))
    back = rows.select("seq", F.col("state").isNull().alias("deleted"), "configured_name", *[f"state.{n}" for n in scope.SCOPE_FIELDS])
    back.write.mode("overwrite").parquet(f"{folder}/open/group={group}")
    _log(spark, folder, schema, group, late=True).write.mode("overwrite").parquet(f"{folder}/late/group={group}")
    spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{folder}/folded/group={group}")


def _written(spark: SparkSession, folder: str, kind: str, schema: T.StructType, folded: int) -> DataFrame:
    """What complete folds left in their folders."""
    numbered = T.StructType([*schema.fields, T.StructField("group", T.IntegerType())])
    return _read(spark, f"{folder}/{kind}", numbered).where(F.col("group") <= folded).select(*schema.names)


def audit_rows(spark: SparkSession, folder: str, start: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per change: each state against the one before it; a rewrite without a change is none.

    ``start`` is the scope before the stream. Closed steps are read as they are; only open changes
    are put in order.
    """
    schema, folded = _typed(schema), _last_folded(spark, folder)
    base = _read(spark, f"{folder}/base/group={folded}", _state_schema(schema))
    steps = _written(spark, folder, "steps", _step_schema(schema), folded).unionByName(_steps(base, _not_closed(spark, folder, schema, folded)))
    first = start.select("configured_name", F.struct(*scope.SCOPE_FIELDS).alias("at_start"))
    known = steps.where("first").drop("old").join(first, "configured_name", "left").withColumnRenamed("at_start", "old")
    return scope.audit_steps(known.unionByName(steps.where("NOT first"), allowMissingColumns=True))


def snapshot(spark: SparkSession, folder: str, start: DataFrame, schema: T.StructType) -> DataFrame:
    """The scope after all changes."""
    schema, folded = _typed(schema), _last_folded(spark, folder)
    base = _read(spark, f"{folder}/base/group={folded}", _state_schema(schema))
    first = start.select("configured_name", F.lit(NO_MARK).cast("long").alias("seq"), F.struct(*scope.SCOPE_FIELDS).alias("state"))
    last = _last(first.unionByName(base).unionByName(_not_closed(spark, folder, schema, folded)))
    return last.where("state IS NOT NULL").select("configured_name", "state.*")


def late_changes(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Changes that came when what follows them was closed already."""
    schema, folded = _typed(schema), _last_folded(spark, folder)
    return _written(spark, folder, "late", schema, folded).unionByName(_log(spark, folder, schema, folded + 1, late=True))
