"""Modification thresholds and ratios as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import Fields, c, expressions, first_match, holds
from statwarden.functions.numeric import dec, percent_of_rows_ceiling, rounded_percent, truncated_percent

# fixed values: a small table always needs 500 changes, larger ones 500 + 20 %
SMALL_TABLE_ROWS = 500
BASE_CHANGES = 500.0
LINEAR_SHARE = 0.2
DYNAMIC_FACTOR = 1000.0


def dynamic_by_level(product_major: Column, engine_edition: Column, compat_level: Column) -> Column:
    return ((product_major >= 13) | (engine_edition == 8)) & (compat_level >= 130)


def native_basis(unfiltered_rows: Column, stats_rows: Column) -> Column:
    return F.coalesce(unfiltered_rows, stats_rows)


def native_threshold(basis: Column, by_level: Column, dynamic_flag: Column) -> Column:
    """Changes after which the engine refreshes by itself, in floating point as there."""
    n = basis.cast("double")
    linear = F.lit(BASE_CHANGES) + F.lit(LINEAR_SHARE) * n
    square_root = F.sqrt(F.lit(DYNAMIC_FACTOR) * n)
    changes = (
        F.when(basis <= SMALL_TABLE_ROWS, F.lit(BASE_CHANGES))
        .when(by_level | dynamic_flag, F.least(linear, square_root))
        .when(basis.isNotNull(), linear)
    )
    return F.floor(changes).try_cast("bigint")


def native_policy(basis: Column, by_level: Column, dynamic_flag: Column) -> Column:
    return first_match(
        [
            (basis.isNull(), "UNAVAILABLE"),
            (basis <= SMALL_TABLE_ROWS, "SMALL_TABLE_FIXED_500"),
            (by_level, "DYNAMIC_COMPAT_130_PLUS"),
            (dynamic_flag, "DYNAMIC_GLOBAL_TF2371"),
        ],
        "LEGACY_FIXED_20_PERCENT_PLUS_500",
    )


def native_formula(basis: Column, by_level: Column, dynamic_flag: Column) -> Column:
    return first_match(
        [
            (basis.isNull(), "UNAVAILABLE"),
            (basis <= SMALL_TABLE_ROWS, "500"),
            (by_level | dynamic_flag, "MIN(500 + (0.20 * n), SQRT(1000 * n))"),
        ],
        "500 + (0.20 * n)",
    )


def remaining_changes(threshold: Column, changes: Column) -> Column:
    return F.when(changes >= threshold, F.lit(0).cast("bigint")).when(changes < threshold, threshold - changes)


def threshold_state(f: Fields) -> Column:
    """Ten-way label of a statistic against its native threshold; first match wins."""
    reached = f.modification_counter >= f.native_threshold
    auto_off = ~f.auto_update_on
    return first_match(
        [
            (~holds(f.properties_available), "STATISTICS_PROPERTIES_UNAVAILABLE"),
            (f.native_basis.isNull() | f.native_threshold.isNull(), "THRESHOLD_BASIS_UNAVAILABLE"),
            (f.modification_counter.isNull(), "MODIFICATION_COUNTER_UNAVAILABLE"),
            (f.temporary, "TEMPORARY_STATISTIC_CONTEXT_REVIEW"),
            (f.no_recompute, "NORECOMPUTE_AUTO_UPDATE_DISABLED"),
            (auto_off & reached, "THRESHOLD_REACHED_AUTO_UPDATE_OFF"),
            (auto_off, "BELOW_THRESHOLD_AUTO_UPDATE_OFF"),
            (reached & f.auto_update_async, "THRESHOLD_REACHED_ASYNC"),
            (reached, "THRESHOLD_REACHED_SYNC"),
        ],
        "BELOW_THRESHOLD",
    )


def threshold_applicable(f: Fields) -> Column:
    missing = (
        ~holds(f.properties_available)
        | f.native_basis.isNull()
        | f.native_threshold.isNull()
        | f.modification_counter.isNull()
    )
    return ~(missing | holds(f.no_recompute) | holds(f.temporary))


def row_count_delta(f: Fields) -> Column:
    return f.current_rows - native_basis(f.unfiltered_rows, f.stats_rows)


@expressions
def _native_columns() -> list[Column]:
    by_level = dynamic_by_level(c.product_major, c.engine_edition, c.compat_level)
    basis = native_basis(c.unfiltered_rows, c.stats_rows)
    return [
        basis.alias("native_basis"),
        native_threshold(basis, by_level, c.dynamic_flag).alias("native_threshold"),
        native_policy(basis, by_level, c.dynamic_flag).alias("native_policy"),
        native_formula(basis, by_level, c.dynamic_flag).alias("native_formula"),
    ]


@expressions
def _native_progress_columns() -> list[Column]:
    return [
        c.native_threshold.isNotNull().alias("native_is_estimate"),
        remaining_changes(c.native_threshold, c.modification_counter).alias("native_remaining"),
        truncated_percent(c.modification_counter, c.native_threshold).alias("native_progress_percent"),
        (c.modification_counter >= c.native_threshold).alias("native_reached"),
        threshold_applicable(c).alias("native_applicable"),
        threshold_state(c).alias("native_state"),
        row_count_delta(c).alias("row_count_delta"),
    ]


def with_native_threshold(facts: DataFrame) -> DataFrame:
    """Adds the native threshold, its progress and its state to statistic facts."""
    return facts.select("*", *_native_columns()).select("*", *_native_progress_columns())


def governance_threshold(rows: Column, percent: Column, min_changes: Column) -> Column:
    """Changes after which policy asks for a refresh."""
    share = percent_of_rows_ceiling(rows, percent)
    return F.when(rows == 0, F.greatest(min_changes, F.lit(1))).when(share.isNotNull(), F.greatest(share, min_changes))


def threshold_comparison(governance: Column, native: Column) -> Column:
    return first_match(
        [
            (governance < native, "GOVERNANCE_EARLIER"),
            (governance > native, "GOVERNANCE_LATER"),
            (governance == native, "SAME_THRESHOLD"),
        ]
    )


def threshold_delta(governance: Column, native: Column) -> Column:
    return (dec(governance, 38, 0) - dec(native, 38, 0)).try_cast("bigint")


def modification_ratio(changes: Column, rows: Column) -> Column:
    return rounded_percent(changes, rows, 28)


def sample_ratio(sampled: Column, rows: Column) -> Column:
    return rounded_percent(sampled, rows, 19)


def low_sample_limit(base: Column, legacy: Column, multiplier: Column) -> Column:
    """Base limit, raised for the legacy estimator, never above 100."""
    raised = F.when(legacy, dec(base, 19, 6) * dec(multiplier, 9, 4)).otherwise(dec(base, 19, 6))
    return dec(F.when(raised > 100, F.lit(100)).otherwise(raised), 19, 6)
