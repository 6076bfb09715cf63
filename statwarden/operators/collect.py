"""Facts of statistics on a lake: column states per file, and what the refreshes left.

A table is a set of pieces: files, partitions or key ranges that come and go whole. One
scan of a new piece gives one state per column: rows, known rows, a distinct sketch, the
lowest and the highest value. States merge, so adding pieces costs a scan of these and a
merge with the state so far; when pieces go, the states of those that stay are merged
again and no data is read. Every change is a commit with the rows it moved. A refresh
remembers how many rows its table had seen moved, so a modification counter is the
difference of two totals, whatever the number of files in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.functions.numeric import truncated_percent
from statwarden.operators.profile import placed_value, plain_value, profiled
from statwarden.sources import store

PIECE = ["table_name", "piece"]
COLUMN = ["table_name", "column_name"]
# Texts are kept by their beginnings, which order like the texts.
TEXT_CHARACTERS = 64
SKETCH_BITS = 12
VALUE_TYPE = "struct<long_value: bigint, double_value: double, decimal_value: decimal(38,18), text_value: string>"
STATES = f"table_name string, piece string, rows bigint, column_name string, known_rows bigint, sketch binary, low {VALUE_TYPE}, high {VALUE_TYPE}"
COMMITS = "table_name string, kind string, pieces bigint, rows bigint, at timestamp_ntz"
# what a refresh leaves behind; ``changed_rows`` is the table's total of moved rows at that time
REFRESHES = (
    "table_name string, column_name string, last_updated timestamp_ntz, stats_rows bigint, rows_sampled bigint, steps bigint, estimated_rows bigint, "
    "max_equal_rows bigint, top3_equal_rows bigint, persisted_percent decimal(19,6), changed_rows bigint, elapsed_seconds double"
)


def piece_states(df: DataFrame, table_name: str, piece: Column) -> DataFrame:
    """One row per piece and column, by one aggregation that combines before its shuffle."""
    ordered = set(profiled(df))

    def found(i: int, name: str) -> list[Column]:
        known = F.col(name).isNotNull()
        sketch = F.hll_sketch_agg(F.when(known, F.xxhash64(name)), F.lit(SKETCH_BITS))
        ends = []
        if name in ordered:
            place, value = plain_value(df, name)
            value = F.left(value, F.lit(TEXT_CHARACTERS)) if place == "text_value" else value
            ends = [F.min(value).alias(f"__low_{i}"), F.max(value).alias(f"__high_{i}")]
        return [F.count_if(known).alias(f"__known_{i}"), sketch.alias(f"__sketch_{i}"), *ends]

    def state(i: int, name: str) -> Column:
        # extremes are plain values while rows are met, and get their shape once per piece
        def end(column: str) -> Column:
            if name not in ordered:
                return F.lit(None).cast(VALUE_TYPE)
            return F.when(F.col(column).isNotNull(), F.struct(*placed_value(plain_value(df, name)[0], F.col(column))).cast(VALUE_TYPE))

        return F.struct(
            F.lit(name).alias("column_name"), F.col(f"__known_{i}").alias("known_rows"), F.col(f"__sketch_{i}").alias("sketch"),
            end(f"__low_{i}").alias("low"), end(f"__high_{i}").alias("high"),
        )

    per_piece = df.groupBy(piece.cast("string").alias("__piece")).agg(F.count(F.lit(1)).alias("__rows"), *[c for i, n in enumerate(df.columns) for c in found(i, n)])
    every = F.explode(F.array(*[state(i, n) for i, n in enumerate(df.columns)])).alias("s")
    rows = per_piece.select(F.lit(table_name).alias("table_name"), F.col("__piece").alias("piece"), F.col("__rows").alias("rows"), every)
    return rows.select(*PIECE, "rows", "s.*")


def merge(states: DataFrame) -> DataFrame:
    """One state per column out of any states: sums, united sketches, extremes."""
    return states.groupBy(*COLUMN).agg(
        F.sum("rows").alias("rows"), F.sum("known_rows").alias("known_rows"), F.hll_union_agg("sketch").alias("sketch"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


class ColumnStates:
    """The states of a lake's tables in a folder; a commit is valid once its row in ``commits`` is written, which comes last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str, version: int) -> DataFrame:
        if not store.is_there(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, version int")
        return self.spark.read.schema(f"{schema}, version int").parquet(f"{self.folder}/{name}").where(F.col("version") <= version)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        # a commit that was cut off is written over by the next one
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")

    def version(self) -> int:
        """The last commit; 0 before the first."""
        return self._read("commits", COMMITS, 2**31 - 1).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def live(self, version: int) -> DataFrame:
        """States of the pieces there are; a piece may go and come again."""
        gone = self._read("gone", "table_name string, piece string", version).groupBy(*PIECE).agg(F.max("version").alias("gone_at"))
        states = self._read("states", STATES, version)
        return states.join(gone, PIECE, "left").where("gone_at IS NULL OR gone_at < version").drop("gone_at", "version")

    def merged(self, version: int | None = None) -> DataFrame:
        """The state of each column after a commit: a single small folder."""
        version = self.version() if version is None else version
        path = f"{self.folder}/merged/version={version}"
        return merge(self.live(0)) if not version else self.spark.read.parquet(path)

    def totals(self, version: int | None = None) -> DataFrame:
        """Per table: rows there are, and rows moved by all commits."""
        sign = F.when(F.col("kind") == "ADDED", F.col("rows")).otherwise(-F.col("rows"))
        commits = self._read("commits", COMMITS, self.version() if version is None else version)
        return commits.groupBy("table_name").agg(F.sum(sign).alias("current_rows"), F.sum("rows").alias("changed_rows"))

    def add(self, tables: Mapping[str, DataFrame], pieces: Mapping[str, Column], at: datetime) -> int:
        """Adds the pieces of the frames that are not there yet; a piece that is there is left as it is."""
        before = self.version()
        found = reduce(DataFrame.unionByName, [piece_states(df, name, pieces[name]) for name, df in tables.items()])
        known = self.live(before).select(*PIECE).distinct()
        self._write(found.join(known, PIECE, "left_anti"), "states", before + 1)
        new = self.spark.read.parquet(f"{self.folder}/states/version={before + 1}")
        state = new if not before else self.merged(before).unionByName(new.drop("piece"))
        return self._commit(merge(state), new, "ADDED", before + 1, at)

    def remove(self, gone: DataFrame, at: datetime) -> int:
        """Takes out pieces (table_name, piece); the others' states are merged again."""
        before = self.version()
        left = self.live(before)
        listed = gone.select(*PIECE).distinct()
        taken = left.join(listed, PIECE, "left_semi")
        self._write(taken.select(*PIECE).distinct(), "gone", before + 1)
        return self._commit(merge(left.join(listed, PIECE, "left_anti")), taken, "REMOVED", before + 1, at)

    def _commit(self, merged: DataFrame, moved: DataFrame, kind: str, version: int, at: datetime) -> int:
        self._write(merged, "merged", version)
        per_table = moved.select(*PIECE, "rows").distinct().groupBy("table_name")
        rows = per_table.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("pieces"), F.sum("rows").alias("rows"), F.lit(at).cast("timestamp_ntz").alias("at"))
        self._write(rows, "commits", version)
        return version


class RefreshLog:
    """What refreshes left, one folder per run and unit of work, so that writing a unit again replaces it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> DataFrame:
        if not store.is_there(self.spark, self.folder):
            return self.spark.createDataFrame([], REFRESHES)
        return self.spark.read.schema(REFRESHES).parquet(self.folder)

    def latest(self) -> DataFrame:
        """The last refresh of each column."""
        names = [part.split(" ")[0] for part in REFRESHES.split(", ") if " " in part and not part.startswith(("table_name", "column_name"))]
        last = self.entries().groupBy(*COLUMN).agg(F.max_by(F.struct(*names), F.struct("last_updated", "changed_rows")).alias("r"))
        return last.select(*COLUMN, "r.*")

    def record(self, refreshed: DataFrame, run_id: str, unit: int) -> None:
        names = [field.name for field in self.spark.createDataFrame([], REFRESHES).schema]
        refreshed.select(*names).write.mode("overwrite").parquet(f"{self.folder}/run={run_id}/unit={unit}")


def lake_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], database_id: int, database_name: str, schema_name: str, created_at: datetime) -> DataFrame:
    """A statistic per column of every table, numbered by name and place; from the schemas, without a job."""
    rows = [
        (database_id, database_name, schema_name, n, table, created_at, i, column, column, column in ordered)
        for n, table in enumerate(sorted(tables), 1)
        for ordered in [set(profiled(tables[table]))]
        for i, column in enumerate(tables[table].columns, 1)
    ]
    schema = (
        "database_id int, database_name string, schema_name string, object_id int, table_name string, created_at timestamp_ntz, "
        "stats_id int, stat_name string, column_name string, has_order boolean"
    )
    return spark.createDataFrame(rows, schema)


# fixed values: columns of a statistic that a lake column has always
PLAIN = {
    **dict.fromkeys(("is_ms_shipped", "is_external", "has_filter", "memory_optimized", "temporary", "base_index_disabled", "index_disabled", "hypothetical", "incremental", "no_recompute", "user_created"), False),
    "auto_created": True,
}
# per database, see ``facts``
ENVIRONMENT = (
    "compat_level", "product_major", "engine_edition", "legacy_ce", "dynamic_flag", "auto_update_on", "auto_update_async",
    "writable_primary", "supports_maxdop", "supports_persist", "has_persist_metadata", "rebuild_keeps",
)


def facts(catalog: DataFrame, states: ColumnStates, refreshes: RefreshLog, environment: DataFrame, version: int | None = None) -> DataFrame:
    """The facts a run decides on: catalog, present rows and states, last refresh and rows moved since then.

    ``environment`` has one row per database_id with the columns ``ENVIRONMENT``.
    """
    totals = states.totals(version).withColumnRenamed("changed_rows", "changed_now")
    merged = states.merged(version).select(*COLUMN, "known_rows", F.hll_sketch_estimate("sketch").alias("distinct_estimate"), "low", "high")
    last = refreshes.latest().withColumn("found", F.lit(True))
    df = catalog.join(totals, "table_name", "left").join(merged, COLUMN, "left").join(last, COLUMN, "left").join(environment.select("database_id", *ENVIRONMENT), "database_id", "left")
    refreshed = F.col("found").isNotNull()
    moved = F.when(refreshed, F.col("changed_now") - F.col("changed_rows")).otherwise(F.col("changed_now"))
    steps = F.coalesce("steps", F.lit(0))
    return df.select(
        *catalog.columns, "current_rows", "known_rows", "distinct_estimate", "low", "high", "stats_rows", F.col("stats_rows").alias("unfiltered_rows"), "rows_sampled",
        "last_updated", "steps", moved.alias("modification_counter"), F.coalesce("persisted_percent", F.lit(0).cast("decimal(19,6)")).alias("persisted_percent"),
        F.col("has_order").alias("properties_available"),
        F.when(~F.col("has_order"), "STATISTICS_PROPERTIES_UNAVAILABLE").when(steps == 0, "NO_HISTOGRAM_ROWS").otherwise("AVAILABLE").alias("histogram_status"),
        truncated_percent(F.col("max_equal_rows"), F.col("estimated_rows")).alias("dominant_percent"),
        truncated_percent(F.col("top3_equal_rows"), F.col("estimated_rows")).alias("top3_percent"),
        F.lit(None).cast("int").alias("index_type"), *[F.lit(v).alias(k) for k, v in PLAIN.items()], *ENVIRONMENT,
    )


def refreshed(results: DataFrame, totals: DataFrame, at: datetime, elapsed_seconds: float) -> DataFrame:
    """Entries of the refresh log for results of ``refresh_batch`` with ``persisted_percent``, read when the tables had ``totals``."""
    df = results.join(totals.select("table_name", F.col("current_rows").alias("rows_now"), "changed_rows"), "table_name", "left")
    return df.select(
        *COLUMN, F.lit(at).cast("timestamp_ntz").alias("last_updated"), F.col("rows_now").alias("stats_rows"), F.col("after_rows_sampled").alias("rows_sampled"),
        F.col("after_steps").alias("steps"), "estimated_rows", "max_equal_rows", "top3_equal_rows", F.col("persisted_percent").cast("decimal(19,6)").alias("persisted_percent"),
        "changed_rows", F.lit(float(elapsed_seconds)).alias("elapsed_seconds"),
    )


def table_costs(catalog: DataFrame, refreshes: DataFrame, totals: DataFrame, default_rate: float = 0.0) -> DataFrame:
    """(database_id, object_id, cost_seconds): what a scan of each table will take.

    Seconds per row from the table's own refreshes, else from all refreshes, else the default.
    """
    scans = refreshes.groupBy("table_name", "last_updated").agg(F.max("elapsed_seconds").alias("seconds"), F.max("stats_rows").alias("rows"))
    own = scans.groupBy("table_name").agg((F.sum("seconds") / F.sum(F.when(F.col("rows") > 0, F.col("rows")))).alias("own_rate"))
    every = scans.agg((F.sum("seconds") / F.sum(F.when(F.col("rows") > 0, F.col("rows")))).alias("every_rate"))
    rate = F.coalesce("own_rate", "every_rate", F.lit(default_rate))
    tables = catalog.select("database_id", "object_id", "table_name").distinct()
    known = tables.join(totals, "table_name", "left").join(own, "table_name", "left").crossJoin(F.broadcast(every))
    return known.select("database_id", "object_id", F.ceil(rate * F.coalesce("current_rows", F.lit(0))).cast("bigint").alias("cost_seconds"))
