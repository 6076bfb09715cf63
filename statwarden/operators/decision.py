"""The refresh decision: for each statistic, whether, how and how persistently.

``decide`` takes facts already joined with policy columns (``p_`` prefix) and the
winning override (``o_`` prefix) and adds 26 decision columns. It is a chain of
narrow projections: no shuffle, no Python per row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import Fields, c, expressions, fails, first_match, holds, settle
from statwarden.functions.numeric import dec, truncated_percent
from statwarden.operators import thresholds as thr

PERCENT_TOLERANCE = Decimal("0.0001")  # fixed value

# fixed values: the reasons under which a statistic is refreshed
ELIGIBLE_REASONS = (
    "APPROVED_FORCE_REFRESH",
    "MISSING_STATISTICS_BLOB",
    "ZERO_BASELINE_WITH_MODIFICATIONS",
    "MODIFICATION_THRESHOLD",
)

# fixed values: index types that are reported but not refreshed
DEFERRED_INDEX_TYPES = {
    5: "COLUMNSTORE_INDEX_STATISTIC_DEFERRED",
    6: "COLUMNSTORE_INDEX_STATISTIC_DEFERRED",
    3: "XML_INDEX_STATISTIC_DEFERRED",
    4: "SPATIAL_INDEX_STATISTIC_DEFERRED",
    7: "HASH_INDEX_STATISTIC_DEFERRED",
    9: "JSON_INDEX_STATISTIC_DEFERRED",
}

DECISION_COLUMNS = (
    "is_eligible", "reason", "collection_method", "requested_sample_percent", "requested_sample_rows",
    "sampling_source", "persist_option", "mod_ratio_percent", "actual_sample_percent", "low_sample_warning",
    "low_sample_limit_percent", "histogram_dominant_percent", "histogram_top3_percent", "skew_class",
    "fullscan_eligible", "fullscan_reason", "can_execute", "capability_reason", "persistence_advisory",
    "governance_basis_rows", "governance_threshold", "governance_remaining", "governance_progress_percent",
    "governance_reached", "governance_native_delta", "governance_native_comparison",
)

# steps of the decision that are dropped at its end
WORK_COLUMNS = (
    "ladder_reason", "ladder_eligible", "d_route", "d_mode", "row_conflict", "d_method", "wanted_percent", "wanted_rows",
    "d_source", "persistence", "d_persist",
)

POLICY_DEFAULTS = {
    "update_threshold_percent": ("decimal(9,4)", Decimal(10)),
    "min_modifications": ("bigint", 500),
    "cooldown_minutes": ("int", 60),
    "row_floor": ("bigint", 1_000_000),
    "large_table_rows": ("bigint", 20_000_000),
    "default_percent": ("decimal(9,4)", None),
    "low_sample_percent": ("decimal(9,4)", Decimal(2)),
    "legacy_multiplier": ("decimal(9,4)", Decimal(2)),
    "skew_enabled": ("boolean", False),
    "moderate_skew_percent": ("decimal(19,6)", Decimal(5)),
    "high_skew_percent": ("decimal(19,6)", Decimal(10)),
    "extreme_skew_percent": ("decimal(19,6)", Decimal(25)),
    "high_skew_rows": ("bigint", 5_000_000),
    "extreme_skew_rows": ("bigint", 10_000_000),
}


def complete_policy(policy: DataFrame) -> DataFrame:
    """Policy rows with every missing setting at its default, columns prefixed ``p_``."""
    given = set(policy.columns)
    settings = []
    for name, (kind, default) in POLICY_DEFAULTS.items():
        value = F.lit(default).cast(kind)
        if name in given:
            # NULL means "no default sample" there; elsewhere it means "not set"
            value = F.col(name).cast(kind) if default is None else F.coalesce(F.col(name).cast(kind), value)
        settings.append(value.alias(f"p_{name}"))
    others = [F.col(c) for c in policy.columns if c not in POLICY_DEFAULTS]
    return policy.select(*others, *settings)


@expressions
def skew_class(f: Fields) -> Column:
    known = (f.histogram_status == "AVAILABLE") & f.dominant_percent.isNotNull()
    return first_match(
        [
            (fails(known), "UNKNOWN"),
            (f.dominant_percent >= f.p_extreme_skew_percent, "EXTREME"),
            (f.dominant_percent >= f.p_high_skew_percent, "HIGH"),
            (f.dominant_percent >= f.p_moderate_skew_percent, "MODERATE"),
        ],
        "LOW",
    )


@expressions
def eligibility_reason(f: Fields) -> Column:
    """Safety restrictions first, then row counts, approvals and thresholds."""
    changes, ratio = f.modification_counter, f.mod_ratio_percent
    safety = [
        (fails(f.writable_primary), "DATABASE_NOT_WRITABLE_PRIMARY"),
        (f.memory_optimized, "MEMORY_OPTIMIZED_MANUAL_REVIEW_V1"),
        (f.temporary, "TEMPORARY_STATISTIC_NOT_SUPPORTED"),
        (f.base_index_disabled | f.index_disabled | f.hypothetical, "DISABLED_OR_HYPOTHETICAL_INDEX"),
    ]
    families = [(f.index_type == kind, reason) for kind, reason in DEFERRED_INDEX_TYPES.items()]
    restrictions = [
        (~f.index_type.isin(1, 2), "UNKNOWN_INDEX_FAMILY_DEFERRED"),
        (f.incremental, "INCREMENTAL_PARTITION_EXECUTOR_DEFERRED_V1"),
        (f.o_action == "EXCLUDE", "EXPLICIT_EXCLUSION"),
        (fails(f.properties_available), "STATISTICS_PROPERTIES_UNAVAILABLE"),
        (f.current_rows.isNull(), "CURRENT_ROWCOUNT_UNAVAILABLE"),
        (f.current_rows == 0, "EMPTY_TABLE"),
        ((f.current_rows < f.p_row_floor) & f.o_action.isNull(), "BELOW_ROWCOUNT_FLOOR"),
        (f.stats_age_minutes < f.p_cooldown_minutes, "UPDATE_COOLDOWN"),
    ]
    staleness = [
        (f.o_force_update, "APPROVED_FORCE_REFRESH"),
        (f.last_updated.isNull() & f.has_filter, "FILTERED_EMPTY_OR_UNINITIALIZED_REVIEW"),
        (f.last_updated.isNull(), "MISSING_STATISTICS_BLOB"),
        (changes.isNull(), "MODIFICATION_COUNTER_UNAVAILABLE"),
        ((changes < f.p_min_modifications) | (changes == 0), "BELOW_MIN_MODIFICATIONS"),
        (f.stats_rows == 0, "ZERO_BASELINE_WITH_MODIFICATIONS"),
        (ratio >= f.p_update_threshold_percent, "MODIFICATION_THRESHOLD"),
    ]
    return first_match(safety + families + restrictions + staleness, "BELOW_MODIFICATION_THRESHOLD")


@expressions
def _ratio_columns() -> list[Column]:
    threshold = thr.governance_threshold(c.stats_rows, c.p_update_threshold_percent, c.p_min_modifications)
    return [
        threshold.alias("governance_threshold"),
        thr.modification_ratio(c.modification_counter, c.stats_rows).alias("mod_ratio_percent"),
        thr.sample_ratio(c.rows_sampled, c.stats_rows).alias("actual_sample_percent"),
        thr.low_sample_limit(c.p_low_sample_percent, c.legacy_ce, c.p_legacy_multiplier).alias("low_sample_limit_percent"),
        skew_class(c).alias("skew_class"),
    ]


@expressions
def _progress_columns() -> list[Column]:
    governance, native, changes = c.governance_threshold, c.native_threshold, c.modification_counter
    return [
        c.stats_rows.alias("governance_basis_rows"),
        thr.remaining_changes(governance, changes).alias("governance_remaining"),
        truncated_percent(changes, governance).alias("governance_progress_percent"),
        (changes >= governance).alias("governance_reached"),
        thr.threshold_delta(governance, native).alias("governance_native_delta"),
        thr.threshold_comparison(governance, native).alias("governance_native_comparison"),
        holds(c.actual_sample_percent < c.low_sample_limit_percent).alias("low_sample_warning"),
        c.dominant_percent.alias("histogram_dominant_percent"),
        c.top3_percent.alias("histogram_top3_percent"),
    ]


def with_ladder(df: DataFrame) -> DataFrame:
    """Governance threshold, ratios, skew class and the first outcome of the ladder."""
    df = settle(df.select("*", *_ratio_columns()).select("*", *_progress_columns()), {"ladder_reason": eligibility_reason(c)})
    return df.select("*", c.ladder_reason.isin(*ELIGIBLE_REASONS).alias("ladder_eligible"))


def row_override_conflict(f: Fields) -> Column:
    """Why an approved row sample cannot be used; NULL when it can."""
    mode = F.coalesce(f.o_persistence_mode, F.lit("KEEP"))
    return first_match(
        [
            (f.o_sample_rows.isNull() | (f.o_sample_rows <= 0), "INVALID_SAMPLE_ROWS_OVERRIDE"),
            (mode == "ON", "SAMPLE_ROWS_CANNOT_PERSIST_ROW_COUNT"),
            ((f.persisted_percent > 0) & (mode == "KEEP"), "ROW_SAMPLE_CONFLICTS_WITH_PERSISTED_PERCENT"),
        ]
    )


@expressions
def sampling_route(f: Fields) -> Column:
    """Which rule chooses the sampling method of an eligible statistic."""
    persisted = (f.persisted_percent > 0) & f.supports_persist & f.has_persist_metadata
    large = F.coalesce(f.stats_rows, f.current_rows) >= f.p_large_table_rows
    return first_match(
        [
            (f.o_action == "FORCE_FULLSCAN", "FULLSCAN"),
            (f.o_action == "FORCE_SAMPLE_PERCENT", "OVERRIDE_PERCENT"),
            (f.o_action == "FORCE_SAMPLE_ROWS", "OVERRIDE_ROWS"),
            (persisted, "PERSISTED"),
            (f.p_skew_enabled & large & f.skew_class.isin("HIGH", "EXTREME"), "SKEW"),
            (f.o_action.isNull() & f.p_default_percent.isNotNull() & large, "DEFAULT_PERCENT"),
        ],
        "SQL_DEFAULT",
    )


@expressions
def _method_columns() -> list[Column]:
    by_rows = c.d_route == "OVERRIDE_ROWS"
    extreme = c.skew_class == "EXTREME"
    wanted = F.when(by_rows, c.o_sample_rows).when(
        c.d_route == "SKEW", F.when(extreme, c.p_extreme_skew_rows).otherwise(c.p_high_skew_rows)
    )
    capped = wanted > c.current_rows
    return [
        F.when(by_rows, row_override_conflict(c)).alias("row_conflict"),
        first_match(
            [
                (c.d_route == "FULLSCAN", "FULLSCAN"),
                (c.d_route.isin("OVERRIDE_PERCENT", "PERSISTED", "DEFAULT_PERCENT"), "SAMPLE_PERCENT"),
                (c.d_route.isin("OVERRIDE_ROWS", "SKEW"), "SAMPLE_ROWS"),
            ],
            "AUTO",
        ).alias("d_method"),
        first_match(
            [
                (c.d_route == "FULLSCAN", dec(F.lit(100), 19, 6)),
                (c.d_route == "OVERRIDE_PERCENT", dec(c.o_sample_percent, 19, 6)),
                (c.d_route == "PERSISTED", dec(c.persisted_percent, 19, 6)),
                (c.d_route == "DEFAULT_PERCENT", dec(c.p_default_percent, 19, 6)),
            ],
            F.lit(None).cast("decimal(19,6)"),
        ).alias("wanted_percent"),
        F.when(capped, c.current_rows).otherwise(wanted).alias("wanted_rows"),
        first_match(
            [
                (by_rows & capped, "APPROVED_OVERRIDE_CAPPED_TO_ROWS"),
                (c.d_route.isin("FULLSCAN", "OVERRIDE_PERCENT", "OVERRIDE_ROWS"), "APPROVED_OVERRIDE"),
                (c.d_route == "PERSISTED", "EXISTING_PERSISTED_RATE"),
                ((c.d_route == "SKEW") & extreme, "EXTREME_SKEW_SAMPLE_ROWS"),
                (c.d_route == "SKEW", "HIGH_SKEW_SAMPLE_ROWS"),
                (c.d_route == "DEFAULT_PERCENT", "REQUESTED_LARGE_TABLE_SAMPLE"),
            ],
            "SQL_DEFAULT",
        ).alias("d_source"),
    ]


def with_method(df: DataFrame) -> DataFrame:
    """Method, requested amount and source; a conflicting row sample is noted."""
    mode = F.coalesce(c.o_persistence_mode, F.lit("KEEP"))
    return df.select("*", sampling_route(c).alias("d_route"), mode.alias("d_mode")).select("*", *_method_columns())


@expressions
def persist_choice(f: Fields) -> Column:
    """ON, OFF, UNSET or CONFLICT for the persisted sampling rate."""
    unpersisted = F.coalesce(f.persisted_percent, F.lit(0)) == 0
    same_rate = F.abs(f.persisted_percent - f.wanted_percent) <= F.lit(PERCENT_TOLERANCE)
    return first_match(
        [
            ((f.d_method == "SAMPLE_ROWS") & (f.d_route == "OVERRIDE_ROWS") & (f.d_mode == "OFF"), "OFF"),
            (f.d_method.isin("AUTO", "SAMPLE_ROWS"), "UNSET"),
            ((f.d_route == "PERSISTED") | (f.d_mode == "ON"), "ON"),
            (f.d_mode == "OFF", "OFF"),
            (unpersisted & f.supports_persist, "OFF"),
            (~f.supports_persist, "UNSET"),
            (same_rate, "ON"),
        ],
        "CONFLICT",
    )


@expressions
def _conflict_columns() -> dict[str, Column]:
    still = c.ladder_eligible & c.row_conflict.isNull()
    conflict = c.persistence == "CONFLICT"
    return {
        "is_eligible": still & ~conflict,
        "reason": first_match(
            [
                (c.ladder_eligible & c.row_conflict.isNotNull(), c.row_conflict),
                (still & conflict, "PERSISTENCE_CONFLICT_REQUIRES_EXPLICIT_CHOICE"),
            ],
            c.ladder_reason,
        ),
        "d_persist": F.when(c.persistence == "ON", True).when(c.persistence == "OFF", False),
    }


def with_persistence(df: DataFrame) -> DataFrame:
    """Final eligibility after row-sample and persistence conflicts."""
    return settle(df.select("*", persist_choice(c).alias("persistence")), _conflict_columns())


@expressions
def capability_reason(f: Fields) -> Column:
    """Why an eligible statistic cannot be refreshed on its engine; else NULL."""
    persists = f.d_persist.isNotNull()
    unverified = fails(f.supports_persist) | fails(f.has_persist_metadata)
    reason = first_match(
        [
            (f.supports_maxdop.isNull(), "STATISTICS_MAXDOP_CAPABILITY_UNKNOWN"),
            (~f.supports_maxdop, "STATISTICS_MAXDOP_NOT_SUPPORTED_ON_THIS_BUILD"),
            (persists & f.supports_persist.isNull(), "PERSIST_SAMPLE_CAPABILITY_UNKNOWN"),
            (persists & ~f.supports_persist, "PERSIST_SAMPLE_OPTION_NOT_SUPPORTED_ON_THIS_BUILD"),
            (persists & fails(f.has_persist_metadata), "PERSISTED_SAMPLE_METADATA_UNAVAILABLE"),
            ((f.d_source == "EXISTING_PERSISTED_RATE") & unverified, "EXISTING_PERSISTED_RATE_CANNOT_BE_VALIDATED"),
        ]
    )
    return F.when(f.is_eligible, reason)


@expressions
def persistence_advisory(f: Fields) -> Column:
    return first_match(
        [
            (f.supports_persist & ~f.rebuild_keeps, "INDEX_REBUILD_CAN_RESET_PERSISTED_SAMPLE"),
            (f.supports_persist & f.rebuild_keeps.isNull(), "REBUILD_PERSISTENCE_BEHAVIOR_UNKNOWN"),
            (~f.supports_persist, "PERSISTED_SAMPLING_NOT_SUPPORTED_ON_THIS_BUILD"),
        ]
    )


@expressions
def _masked_columns() -> list[Column]:
    fullscan = c.ladder_eligible & (c.d_method == "FULLSCAN")
    return [
        (c.is_eligible & c.capability_reason.isNull()).alias("can_execute"),
        F.when(c.is_eligible, c.d_method).alias("collection_method"),
        F.when(c.is_eligible, c.wanted_percent).alias("requested_sample_percent"),
        F.when(c.is_eligible, c.wanted_rows).alias("requested_sample_rows"),
        F.when(c.is_eligible, c.d_source).alias("sampling_source"),
        F.when(c.is_eligible, c.d_persist).alias("persist_option"),
        # kept even when a later conflict revokes eligibility
        fullscan.alias("fullscan_eligible"),
        F.when(fullscan, F.lit("APPROVED_FORCE_FULLSCAN_OVERRIDE")).alias("fullscan_reason"),
    ]


@expressions
def _gate_columns() -> list[Column]:
    return [capability_reason(c).alias("capability_reason"), persistence_advisory(c).alias("persistence_advisory")]


def with_gate(df: DataFrame) -> DataFrame:
    """Capability gate, advisory and the masked outputs."""
    return df.select("*", *_gate_columns()).select("*", *_masked_columns())


def decide(joined: DataFrame) -> DataFrame:
    """Facts ⋈ policy ⟕ override -> the same rows with the decision columns."""
    df = with_gate(with_persistence(with_method(with_ladder(joined))))
    return df.drop(*WORK_COLUMNS)
