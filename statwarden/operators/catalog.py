"""Statistic facts from catalog frames: enumeration, classification, environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c, Fields, first_match, holds
from statwarden.functions.numeric import truncated_percent
from statwarden.operators.skew import keep, lookup
from statwarden.operators.thresholds import dynamic_by_level

SCOPES = ("ALL", "INDEX_ONLY", "AUTO_ONLY", "USER_ONLY", "NON_AUTO")  # fixed values
# ids of tables are unique within their database only
TABLE_KEY = ["database_id", "object_id"]
COLUMNSTORE_TYPES = (5, 6)
SYSTEM_IDS = (1, 3, 4)

# fixed values: family per index type
INDEX_FAMILIES = {1: "ROWSTORE", 2: "ROWSTORE", 3: "XML", 4: "SPATIAL", 5: "COLUMNSTORE", 6: "COLUMNSTORE", 7: "HASH", 9: "JSON"}


def index_family(index_type: Column) -> Column:
    named = [(index_type == kind, family) for kind, family in INDEX_FAMILIES.items()]
    return first_match([(index_type.isNull(), "STANDALONE"), *named], "UNKNOWN")


def partition_rows(partitions: DataFrame) -> DataFrame:
    """Rows and partitions per table, heap and clustered storage only."""
    return (
        partitions.where(F.col("index_id").isin(0, 1))
        .groupBy(*TABLE_KEY)
        .agg(F.sum("row_count").alias("current_rows"), F.count(F.lit(1)).alias("partition_count"))
    )


def in_statistics_scope(f: Fields, scope: str) -> Column:
    on_index = f.index_type.isNotNull()
    return {
        "ALL": F.lit(True),
        "INDEX_ONLY": on_index,
        "AUTO_ONLY": ~on_index & f.auto_created,
        "USER_ONLY": ~on_index & f.user_created,
        "NON_AUTO": ~f.auto_created,
    }[scope]


def visible(f: Fields) -> Column:
    """No shipped tables outside the system databases, no external tables."""
    return (~f.is_ms_shipped | f.database_id.isin(*SYSTEM_IDS)) & ~f.is_external


def keep_targets(facts: DataFrame, targets: DataFrame | None, sizes: DataFrame | None = None) -> DataFrame:
    """Only targeted tables; everything when no targets are given."""
    if targets is None:
        return facts
    return keep(facts, targets, ["database_name", "schema_name", "table_name"], ["stat_name"], sizes=sizes)


def statistics_context(facts: DataFrame) -> DataFrame:
    """Adds context, storage and type labels; columnstore presence is per table."""
    with_columnstore = (
        facts.where(F.col("index_type").isin(*COLUMNSTORE_TYPES) | F.col("base_index_type").isin(*COLUMNSTORE_TYPES))
        .select(*TABLE_KEY)
        .distinct()
        .withColumn("__columnstore", F.lit(True))
    )
    df = lookup(facts, with_columnstore, TABLE_KEY, ["stats_id"])
    has = holds(F.col("__columnstore"))
    on_index = c.index_type.isNotNull()
    return df.select(
        *facts.columns,
        index_family(c.index_type).alias("index_family"),
        first_match(
            [(on_index, "INDEX_ASSOCIATED"), (has, "STANDALONE_ON_TABLE_WITH_COLUMNSTORE")], "STANDALONE"
        ).alias("statistics_context"),
        first_match(
            [(c.base_index_type == 5, "CLUSTERED_COLUMNSTORE"), (c.base_index_type == 1, "CLUSTERED_ROWSTORE")], "HEAP"
        ).alias("base_storage"),
        has.alias("has_columnstore"),
        first_match([(on_index, "Index"), (c.auto_created, "AutoCreated")], "UserCreated").alias("statistic_type"),
    )


def legacy_estimator(e: Fields) -> Column:
    """Does the database use the legacy estimator? NULL when the flags contradict."""
    both = e.legacy_flag & e.modern_flag
    legacy = (e.compat_level < 120) | e.scoped_legacy | e.legacy_flag
    return F.when(~holds(both), ~holds(e.modern_flag) & holds(legacy))


def estimator_label(legacy: Column) -> Column:
    return first_match([(legacy, "LEGACY_CE_CONTEXT"), (~legacy, "MODERN_CE_CONTEXT")], "AMBIGUOUS_CE_CONTEXT")


def sampling_scan_behavior(e: Fields) -> Column:
    return first_match(
        [
            ((e.engine_edition == 8) | (e.product_major >= 14), "SERIAL_SAMPLING_SCAN_OTHER_OPERATORS_MAY_PARALLELIZE"),
            ((e.product_major == 13) & (e.compat_level == 130), "PARALLEL_SAMPLING_SCAN_POSSIBLE"),
        ],
        "SERIAL_SAMPLING_SCAN",
    )


def threshold_context(e: Fields) -> Column:
    return first_match(
        [
            (dynamic_by_level(e.product_major, e.engine_edition, e.compat_level), "DYNAMIC_COMPAT_130_PLUS"),
            (e.dynamic_flag, "DYNAMIC_GLOBAL_TF2371"),
        ],
        "LEGACY_FIXED_20_PERCENT_PLUS_500",
    )


def wait_evidence(e: Fields) -> Column:
    return first_match(
        [
            (~e.supports_wait_stats, "NOT_SUPPORTED_ON_THIS_BUILD"),
            (~e.query_store_state.isin("READ_WRITE", "READ_ONLY"), "QUERY_STORE_NOT_ACTIVE"),
        ],
        "AVAILABLE_NOT_COLLECTED",
    )


def feedback_evidence(e: Fields) -> Column:
    return first_match(
        [
            (~e.supports_ce_feedback, "NOT_SUPPORTED_ON_THIS_BUILD"),
            (e.ce_feedback_setting.isNull(), "SCOPED_SETTING_UNAVAILABLE_ON_THIS_POLICY"),
            (e.compat_level < 160, "COMPATIBILITY_BELOW_160"),
            (e.query_store_state != "READ_WRITE", "QUERY_STORE_NOT_READ_WRITE"),
            (~e.ce_feedback_setting, "SCOPED_SETTING_NOT_ENABLED"),
        ],
        "DATABASE_PREREQUISITES_MET_NOT_COLLECTED",
    )


def persisted_metadata_status(has_metadata: Column, supports_persist: Column) -> Column:
    return first_match(
        [(has_metadata, "AVAILABLE"), (~has_metadata & ~supports_persist, "NOT_SUPPORTED_ON_THIS_BUILD")],
        "UNAVAILABLE_OR_PROBE_FAILED",
    )


def with_environment(datasets: DataFrame) -> DataFrame:
    """Adds the derived environment labels of each database."""
    return datasets.select(
        "*",
        legacy_estimator(c).alias("legacy_ce"),
        estimator_label(legacy_estimator(c)).alias("estimator_context"),
        sampling_scan_behavior(c).alias("sampling_scan_behavior"),
        threshold_context(c).alias("threshold_context"),
        wait_evidence(c).alias("wait_evidence"),
        feedback_evidence(c).alias("feedback_evidence"),
    )


def partition_health(row_groups: DataFrame) -> DataFrame:
    """Row-group totals per index partition; summed before the shuffle."""
    state, total, deleted = F.col("state"), F.col("total_rows"), F.col("deleted_rows")

    def total_where(condition, value):
        return F.sum(F.when(condition, value).otherwise(0))

    open_or_closed = state.isin(1, 2)
    sums = row_groups.groupBy(*TABLE_KEY, "index_id", "partition_number").agg(
        F.count_if(state == 1).alias("open_rowgroups"),
        F.count_if(state == 2).alias("closed_rowgroups"),
        total_where(open_or_closed, total).alias("delta_rows"),
        total_where(state == 3, total).alias("compressed_rows"),
        total_where(state == 3, deleted).alias("compressed_deleted_rows"),
        total_where(state.isin(1, 2, 3), total - deleted).alias("__live"),
    )
    return sums.select(
        *[c for c in sums.columns if c != "__live"], truncated_percent(c.delta_rows, F.col("__live")).alias("delta_percent")
    )


def canonical_targets(requested: DataFrame, tables: DataFrame) -> DataFrame:
    """Requested (schema_name, table_name) pairs in catalog spelling, once each."""
    wanted = requested.select(
        F.lower("schema_name").alias("schema_key"), F.lower("table_name").alias("table_key")
    ).distinct()
    known = tables.select(
        "database_name", "schema_name", "table_name",
        F.lower("schema_name").alias("schema_key"), F.lower("table_name").alias("table_key"),
    )
    return known.join(wanted, ["schema_key", "table_key"], "left_semi").select(
        "database_name", "schema_name", "table_name"
    ).distinct()


def missing_targets(requested: DataFrame, tables: DataFrame) -> DataFrame:
    """Requested pairs no table answers to."""
    known = tables.select(F.lower("schema_name").alias("schema_key"), F.lower("table_name").alias("table_key"))
    wanted = requested.withColumn("schema_key", F.lower("schema_name")).withColumn("table_key", F.lower("table_name"))
    return wanted.join(known, ["schema_key", "table_key"], "left_anti").select("schema_name", "table_name").distinct()




def owned_tables(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables with the name of their schema."""
    return tables.join(schemas.select("database_id", "schema_id", "schema_name"), ["database_id", "schema_id"])


def enumerate_statistics(
    stats: DataFrame, tables: DataFrame, schemas: DataFrame, indexes: DataFrame, partitions: DataFrame, columns: DataFrame
) -> DataFrame:
    """Every statistic with its table, schema, index, base index, rows and leading column.

    What belongs to a table is gathered first, one row per table; a table with very
    many statistics is then spread over many tasks.
    """
    owner = owned_tables(tables, schemas).join(partition_rows(partitions), TABLE_KEY, "left").select(
        "object_id", "database_id", "database_name", "schema_name", "table_name", "is_ms_shipped", "is_external",
        "is_memory_optimized", "base_index_type", "base_disabled", "current_rows", "partition_count",
    )
    per_stat = indexes.select(
        *TABLE_KEY, F.col("index_id").alias("stats_id"), "index_name", "index_type", "is_disabled", "is_hypothetical"
    )
    leading = columns.select(
        *TABLE_KEY,
        F.col("column_id").alias("leading_column_id"),
        F.col("column_name").alias("leading_column"),
        F.col("data_type").alias("leading_type"),
    )
    df = stats.join(per_stat, [*TABLE_KEY, "stats_id"], "left")
    df = lookup(df, owner, TABLE_KEY, ["stats_id"], how="inner", sizes=stats)
    return lookup(df, leading, [*TABLE_KEY, "leading_column_id"], ["stats_id"], sizes=stats)


def generated_rows(total: DataFrame, block: int = 100_000) -> DataFrame:
    """Rows 1..n for a one-row frame holding ``n``; blocks are spread before they grow."""
    blocks = total.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("block"))
    first = F.col("block") * block + 1
    return (
        blocks.where("n > 0")
        .repartition("block")
        .select(F.explode(F.sequence(first, F.least(first + block - 1, F.col("n")))).alias("id"))
    )
