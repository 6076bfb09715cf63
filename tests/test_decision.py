"""Golden decisions, threshold arithmetic and invariants over the fleet."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statwarden.operators import decision, thresholds
from statwarden.plans.decisions import decided
from statwarden.plans.registry import Inputs

FACTS = {
    "stats_rows": (400000, "bigint"), "current_rows": (400000, "bigint"), "rows_sampled": (5000, "bigint"),
    "modification_counter": (50000, "bigint"), "stats_age_minutes": (120, "bigint"), "index_type": (2, "int"),
    "legacy_ce": (False, "boolean"), "writable_primary": (True, "boolean"), "memory_optimized": (False, "boolean"),
    "temporary": (False, "boolean"), "base_index_disabled": (False, "boolean"), "index_disabled": (False, "boolean"),
    "hypothetical": (False, "boolean"), "incremental": (False, "boolean"), "properties_available": (True, "boolean"),
    "has_filter": (False, "boolean"), "last_updated": (datetime(2026, 9, 20), "timestamp_ntz"), "supports_maxdop": (True, "boolean"),
    "supports_persist": (True, "boolean"), "has_persist_metadata": (True, "boolean"), "rebuild_keeps": (True, "boolean"),
    "histogram_status": ("AVAILABLE", "string"), "dominant_percent": (Decimal(30), "decimal(19,6)"), "top3_percent": (None, "decimal(19,6)"),
    "native_threshold": (20000, "bigint"), "persisted_percent": (None, "decimal(19,6)"),
}
OVERRIDE = {
    "o_override_id": "bigint", "o_action": "string", "o_sample_percent": "decimal(9,4)", "o_sample_rows": "bigint",
    "o_persistence_mode": "string", "o_force_update": "boolean",
}


def one(spark, facts=None, override=None):
    values = {**{k: v for k, (v, _) in FACTS.items()}, **(facts or {})}
    columns = [F.lit(values[k]).cast(t).alias(k) for k, (_, t) in FACTS.items()]
    columns += [F.lit((override or {}).get(k)).cast(t).alias(k) for k, t in OVERRIDE.items()]
    policy = spark.sql("SELECT CAST(0 AS BIGINT) AS row_floor")
    row = spark.range(1).select(*columns).crossJoin(decision.complete_policy(policy))
    return decision.decide(row).head()


def test_skew_alone_gives_no_full_scan(spark):
    d = one(spark)
    assert (d.is_eligible, d.can_execute, d.collection_method, d.fullscan_eligible) == (True, True, "AUTO", False)
    assert (d.skew_class, d.governance_threshold, d.governance_progress_percent) == ("EXTREME", 40000, 125)
    assert d.governance_native_comparison == "GOVERNANCE_LATER"


def test_force_sample_rows(spark):
    d = one(spark, override={"o_action": "FORCE_SAMPLE_ROWS", "o_sample_rows": 25000, "o_persistence_mode": "OFF", "o_force_update": True})
    assert (d.is_eligible, d.can_execute, d.collection_method, d.requested_sample_rows) == (True, True, "SAMPLE_ROWS", 25000)
    assert (d.requested_sample_percent, d.persist_option, d.fullscan_eligible) == (None, False, False)


def test_force_fullscan(spark):
    d = one(spark, override={"o_action": "FORCE_FULLSCAN", "o_persistence_mode": "OFF", "o_force_update": True})
    assert (d.is_eligible, d.can_execute, d.collection_method, d.fullscan_eligible, d.persist_option) == (True, True, "FULLSCAN", True, False)


def test_unsupported_maxdop_blocks_execution(spark):
    d = one(spark, {"supports_maxdop": False})
    assert (d.is_eligible, d.can_execute) == (True, False)
    assert d.capability_reason == "STATISTICS_MAXDOP_NOT_SUPPORTED_ON_THIS_BUILD"


@pytest.mark.parametrize(
    "facts, override, reason",
    [
        ({"modification_counter": 39999}, {}, "BELOW_MODIFICATION_THRESHOLD"),
        ({"modification_counter": 40000}, {}, "MODIFICATION_THRESHOLD"),
        ({"modification_counter": 499}, {}, "BELOW_MIN_MODIFICATIONS"),
        ({"modification_counter": None}, {}, "MODIFICATION_COUNTER_UNAVAILABLE"),
        ({"stats_rows": 0, "modification_counter": 600}, {}, "ZERO_BASELINE_WITH_MODIFICATIONS"),
        ({"stats_age_minutes": 59}, {"o_action": "FORCE_FULLSCAN", "o_force_update": True}, "UPDATE_COOLDOWN"),
        ({"stats_age_minutes": 60}, {"o_action": "FORCE_FULLSCAN", "o_persistence_mode": "ON", "o_force_update": True}, "APPROVED_FORCE_REFRESH"),
        ({"last_updated": None}, {}, "MISSING_STATISTICS_BLOB"),
        ({"last_updated": None, "has_filter": True}, {}, "FILTERED_EMPTY_OR_UNINITIALIZED_REVIEW"),
        ({"writable_primary": None}, {}, "DATABASE_NOT_WRITABLE_PRIMARY"),
        ({"index_type": 8}, {}, "UNKNOWN_INDEX_FAMILY_DEFERRED"),
        ({"index_type": 6}, {}, "COLUMNSTORE_INDEX_STATISTIC_DEFERRED"),
        ({}, {"o_action": "EXCLUDE"}, "EXPLICIT_EXCLUSION"),
        ({}, {"o_action": "FORCE_SAMPLE_ROWS", "o_sample_rows": 0}, "INVALID_SAMPLE_ROWS_OVERRIDE"),
        ({}, {"o_action": "FORCE_SAMPLE_ROWS", "o_sample_rows": 5, "o_persistence_mode": "ON"}, "SAMPLE_ROWS_CANNOT_PERSIST_ROW_COUNT"),
        (
            {"persisted_percent": Decimal(20)},
            {"o_action": "FORCE_SAMPLE_ROWS", "o_sample_rows": 5},
            "ROW_SAMPLE_CONFLICTS_WITH_PERSISTED_PERCENT",
        ),
        (
            {"persisted_percent": Decimal(20)},
            {"o_action": "FORCE_FULLSCAN", "o_force_update": True},
            "PERSISTENCE_CONFLICT_REQUIRES_EXPLICIT_CHOICE",
        ),
    ],
)
def test_reasons(spark, facts, override, reason):
    assert one(spark, facts, override).reason == reason


def test_revoked_full_scan_stays_marked(spark):
    d = one(spark, {"persisted_percent": Decimal(20)}, {"o_action": "FORCE_FULLSCAN", "o_force_update": True})
    assert (d.is_eligible, d.fullscan_eligible, d.collection_method) == (False, True, None)


@pytest.mark.parametrize(
    "rows, compat, flag, expected",
    [
        (None, 150, False, None), (500, 150, False, 500), (501, 150, False, 600), (400000, 150, False, 20000),
        (400000, 120, False, 80500), (400000, 120, True, 20000), (25000, 150, False, 5000),
    ],
)
def test_native_threshold(spark, rows, compat, flag, expected):
    basis = F.lit(rows).cast("bigint")
    level = thresholds.dynamic_by_level(F.lit(16), F.lit(3), F.lit(compat))
    assert spark.range(1).select(thresholds.native_threshold(basis, level, F.lit(flag)).alias("t")).head().t == expected


def test_percent_digits_are_cut_not_rounded(spark):
    from statwarden.functions.numeric import rounded_percent, truncated_percent

    two, three = F.lit(2).cast("bigint"), F.lit(3).cast("bigint")
    row = spark.range(1).select(truncated_percent(two, three).alias("cut"), rounded_percent(two, three, 28).alias("round")).head()
    assert (row.cut, row["round"]) == (Decimal("66.666666"), Decimal("66.666667"))
    assert spark.range(1).select(truncated_percent(F.lit(20_000_000), F.lit(10_000_000)).alias("p")).head().p == 200


def test_invariants_over_the_fleet(spark, sf_dir):
    df = decided(Inputs(spark, sf_dir)).cache()
    masked = "collection_method IS NULL AND requested_sample_percent IS NULL AND requested_sample_rows IS NULL AND sampling_source IS NULL AND persist_option IS NULL"
    reasons = ", ".join(f"'{r}'" for r in decision.ELIGIBLE_REASONS)
    assert df.where(f"NOT is_eligible AND NOT ({masked})").isEmpty()
    assert df.where(f"is_eligible <> (reason IN ({reasons}))").isEmpty()
    assert df.where("can_execute AND (NOT is_eligible OR capability_reason IS NOT NULL)").isEmpty()
    assert df.where("collection_method = 'FULLSCAN' AND o_action <> 'FORCE_FULLSCAN'").isEmpty()
    assert df.where("collection_method = 'AUTO' AND persist_option IS NOT NULL").isEmpty()
    df.unpersist()


def test_filters_pass_the_decision_on_their_way_to_the_scan(spark, sf_dir):
    from statwarden.plans import decisions
    from statwarden.plans.registry import Inputs

    rows = decisions.decided(Inputs(spark, sf_dir)).where("schema_name = 'schema_2' AND is_eligible")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    decided = next(i for i, line in enumerate(plan) if "ladder_reason, CASE" in line)
    assert any("Filter" in line and "= schema_2" in line for line in plan[decided + 1 :])
    assert not any("= schema_2" in line for line in plan[:decided])
