"""Data-quality rules of the governance tables, as DataFrames of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwarden.functions.logic import Fields, c
from statwarden.functions.text import is_blank

ACTIONS = ("REFRESH_AUTO", "FORCE_SAMPLE_ROWS", "FORCE_SAMPLE_PERCENT", "FORCE_FULLSCAN", "EXCLUDE")  # fixed values
PERSISTENCE_MODES = ("KEEP", "ON", "OFF")
SETTINGS_VERSION = "1.3.0"
MAX_LOCK_TIMEOUT_MS = 600_000


def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule. As in SQL, a rule that is unknown is not broken."""
    broken = F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return df.select(*key, F.explode(F.array_compact(broken)).alias("rule"))


def duplicates(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").withColumn("rule", F.lit(rule))


def override_rules(o: Fields) -> dict[str, Column]:
    by_percent, by_rows = o.action == "FORCE_SAMPLE_PERCENT", o.action == "FORCE_SAMPLE_ROWS"
    no_percent, no_rows = o.sample_percent.isNull(), o.sample_rows.isNull()
    return {
        "action": o.action.isin(*ACTIONS),
        "approval": ~is_blank(o.approved_by) & ~is_blank(o.notes) & (o.expires_at.isNull() | (o.expires_at > o.approved_at)),
        "force_expiry": ~o.force_update | (o.expires_at.isNotNull() & (o.action != "EXCLUDE")),
        "persistence": o.persistence_mode.isin(*PERSISTENCE_MODES)
        & (~o.action.isin("REFRESH_AUTO", "EXCLUDE") | (o.persistence_mode == "KEEP"))
        & (~by_rows | (o.persistence_mode != "ON")),
        "sample": (by_percent & ~no_percent & (o.sample_percent > 0) & (o.sample_percent <= 100) & no_rows)
        | (by_rows & ~no_rows & (o.sample_rows > 0) & no_percent)
        | (~by_percent & ~by_rows & no_percent & no_rows),
    }


def override_violations(overrides: DataFrame) -> DataFrame:
    """Row rules plus uniqueness per table and per statistic."""
    rows = violations(overrides, ["override_id"], override_rules(c)).select(
        F.col("override_id").cast("string").alias("subject"), "rule", F.lit(1).cast("bigint").alias("entries")
    )
    table = ["database_name", "schema_name", "table_name"]
    per_table = duplicates(overrides.where("stat_name IS NULL"), table, "one_per_table")
    per_stat = duplicates(overrides.where("stat_name IS NOT NULL"), [*table, "stat_name"], "one_per_statistic")
    named = [
        d.select(F.concat_ws(".", *key).alias("subject"), "rule", "entries")
        for d, key in ((per_table, table), (per_stat, [*table, "stat_name"]))
    ]
    return rows.unionByName(named[0]).unionByName(named[1])


def scope_rules(s: Fields) -> dict[str, Column]:
    return {
        "approval": ~is_blank(s.notes)
        & (~s.enabled | (s.approved_by.isNotNull() & ~is_blank(s.approved_by) & s.approved_at.isNotNull())),
        "exclusion": ~s.is_excluded
        | (
            ~s.enabled
            & s.exclusion_reason.isNotNull() & ~is_blank(s.exclusion_reason)
            & s.excluded_by.isNotNull() & ~is_blank(s.excluded_by)
            & s.excluded_at.isNotNull()
        ),
    }


def scope_violations(scope: DataFrame) -> DataFrame:
    rows = violations(scope, ["configured_name"], scope_rules(c)).withColumn("entries", F.lit(1).cast("bigint"))
    return rows.unionByName(duplicates(scope, ["configured_name"], "one_per_name"))


def settings_rules(s: Fields) -> dict[str, Column]:
    return {
        "singleton": s.settings_id == 1,
        "schema_version": s.schema_version == SETTINGS_VERSION,
        "skew_policy": (s.moderate_skew_percent >= 0)
        & (s.moderate_skew_percent < s.high_skew_percent)
        & (s.high_skew_percent < s.extreme_skew_percent)
        & (s.extreme_skew_percent <= 100)
        & (s.high_skew_sample_rows > 0)
        & (s.extreme_skew_sample_rows >= s.high_skew_sample_rows),
        "ranges": (s.update_threshold_percent > 0)
        & (s.min_modification_count >= 0)
        & (s.min_update_interval_minutes >= 0)
        & s.lock_timeout_ms.between(0, MAX_LOCK_TIMEOUT_MS),
    }


def symmetric_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct rows on one side only, marked MISSING or UNEXPECTED."""
    missing = expected.subtract(actual).withColumn("side", F.lit("MISSING"))
    unexpected = actual.subtract(expected).withColumn("side", F.lit("UNEXPECTED"))
    return missing.unionByName(unexpected)


def schema_rows(spark, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable) of the given schemas."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), f.nullable)
        for table, schema in schemas.items()
        for i, f in enumerate(schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")


def schema_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected columns that are absent or differ in place or type."""
    found = actual.select(
        "table_name", "column_name", F.col("ordinal").alias("actual_ordinal"), F.col("data_type").alias("actual_type")
    )
    df = expected.join(found, ["table_name", "column_name"], "left")
    same = (c.actual_type == c.data_type) & (c.actual_ordinal == c.ordinal)
    return df.where(c.actual_type.isNull() | ~same)
