"""DuckDB CTEs shared by the oracle texts. Written apart from the Spark operators."""

from __future__ import annotations

from statwarden.plans.fixtures import AS_OF, cte

NOW = f"TIMESTAMP '{AS_OF}'"


def pct_cut(a: str, b: str) -> str:
    """100*a/b cut after six decimals."""
    return f"CAST(CAST(CAST({a} AS HUGEINT) * 100000000 // CAST(nullif({b}, 0) AS HUGEINT) AS DECIMAL(25,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(19,6))"


def pct_round(a: str, b: str, precision: int) -> str:
    """100*a/b rounded half up at six decimals, NULL unless b > 0."""
    q = f"(2 * CAST({a} AS HUGEINT) * 100000000 + {b}) // (2 * CAST({b} AS HUGEINT))"
    return f"CASE WHEN {b} > 0 THEN CAST(CAST({q} AS DECIMAL(28,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL({precision},6)) END"


# native threshold of every statistic
NATIVE = f"""
nat0 AS (
  SELECT *, coalesce(unfiltered_rows, stats_rows) AS native_basis,
    coalesce((product_major >= 13 OR engine_edition = 8) AND compat_level >= 130, false) AS by_level
  FROM fleet),
nat1 AS (
  SELECT *,
    CAST(floor(CASE
      WHEN native_basis IS NULL THEN NULL
      WHEN native_basis <= 500 THEN 500.0::DOUBLE
      WHEN by_level OR dynamic_flag THEN
        CASE WHEN 500.0::DOUBLE + 0.2::DOUBLE * native_basis::DOUBLE <= sqrt(1000.0::DOUBLE * native_basis::DOUBLE)
             THEN 500.0::DOUBLE + 0.2::DOUBLE * native_basis::DOUBLE ELSE sqrt(1000.0::DOUBLE * native_basis::DOUBLE) END
      ELSE 500.0::DOUBLE + 0.2::DOUBLE * native_basis::DOUBLE END) AS BIGINT) AS native_threshold,
    CASE WHEN native_basis IS NULL THEN 'UNAVAILABLE' WHEN native_basis <= 500 THEN 'SMALL_TABLE_FIXED_500'
         WHEN by_level THEN 'DYNAMIC_COMPAT_130_PLUS' WHEN dynamic_flag THEN 'DYNAMIC_GLOBAL_TF2371'
         ELSE 'LEGACY_FIXED_20_PERCENT_PLUS_500' END AS native_policy,
    CASE WHEN native_basis IS NULL THEN 'UNAVAILABLE' WHEN native_basis <= 500 THEN '500'
         WHEN by_level OR dynamic_flag THEN 'MIN(500 + (0.20 * n), SQRT(1000 * n))' ELSE '500 + (0.20 * n)' END AS native_formula
  FROM nat0),
native AS (
  SELECT *, native_threshold IS NOT NULL AS native_is_estimate,
    greatest(native_threshold - modification_counter, CASE WHEN native_threshold IS NULL OR modification_counter IS NULL THEN NULL ELSE 0 END) AS native_remaining_raw,
    CASE WHEN native_threshold IS NULL OR modification_counter IS NULL THEN NULL
         WHEN modification_counter >= native_threshold THEN 0 ELSE native_threshold - modification_counter END AS native_remaining,
    {pct_cut('modification_counter', 'native_threshold')} AS native_progress_percent,
    modification_counter >= native_threshold AS native_reached,
    NOT (NOT properties_available OR native_threshold IS NULL OR modification_counter IS NULL OR no_recompute OR temporary) AS native_applicable,
    CASE WHEN NOT properties_available THEN 'STATISTICS_PROPERTIES_UNAVAILABLE'
         WHEN native_threshold IS NULL THEN 'THRESHOLD_BASIS_UNAVAILABLE'
         WHEN modification_counter IS NULL THEN 'MODIFICATION_COUNTER_UNAVAILABLE'
         WHEN temporary THEN 'TEMPORARY_STATISTIC_CONTEXT_REVIEW'
         WHEN no_recompute THEN 'NORECOMPUTE_AUTO_UPDATE_DISABLED'
         WHEN NOT auto_update_on THEN CASE WHEN modification_counter >= native_threshold
              THEN 'THRESHOLD_REACHED_AUTO_UPDATE_OFF' ELSE 'BELOW_THRESHOLD_AUTO_UPDATE_OFF' END
         WHEN modification_counter < native_threshold THEN 'BELOW_THRESHOLD'
         WHEN auto_update_async THEN 'THRESHOLD_REACHED_ASYNC' ELSE 'THRESHOLD_REACHED_SYNC' END AS native_state,
    current_rows - coalesce(unfiltered_rows, stats_rows) AS row_count_delta,
    date_diff('minute', last_updated, {NOW}) AS stats_age_minutes
  FROM nat1)"""

# the winning override of every statistic
WINNER = f"""
live AS (SELECT * FROM overrides WHERE is_enabled AND (expires_at IS NULL OR expires_at > {NOW})),
candidates AS (
  SELECT f.stats_id, o.override_id, o.action AS o_action, o.sample_percent AS o_sample_percent, o.sample_rows AS o_sample_rows,
    o.persistence_mode AS o_persistence_mode, o.force_update AS o_force_update, o.expires_at AS o_expires_at,
    row_number() OVER (PARTITION BY f.stats_id ORDER BY CASE WHEN o.action = 'EXCLUDE' THEN 0 ELSE 1 END,
                       CASE WHEN o.stat_name IS NOT NULL THEN 0 ELSE 1 END, o.override_id) AS rn
  FROM fleet f JOIN live o ON o.database_name = f.database_name AND o.schema_name = f.schema_name
    AND o.table_name = f.table_name AND (o.stat_name = f.stat_name OR o.stat_name IS NULL)),
winner AS (SELECT * FROM candidates WHERE rn = 1)"""

_SETTINGS = """
policy3 AS (
  SELECT *, CAST(10 AS DECIMAL(9,4)) AS threshold, 500 AS min_mods, 60 AS cooldown, 20000000 AS large,
    CAST(2 AS DECIMAL(9,4)) AS low, CAST(2 AS DECIMAL(9,4)) AS multiplier, 5 AS moderate, 10 AS high, 25 AS extreme,
    5000000 AS high_rows, 10000000 AS extreme_rows FROM policy)"""


def decision_chain(source: str) -> str:
    """CTEs d1..decided: the decision over ``source`` (facts x policy with override)."""
    return f"""
d1 AS (
  SELECT *,
    CASE WHEN stats_rows IS NULL THEN NULL WHEN stats_rows = 0 THEN greatest(min_mods, 1)
         ELSE greatest(CAST((CAST(stats_rows AS HUGEINT) * CAST(threshold * 10000 AS BIGINT) + 999999) // 1000000 AS BIGINT), min_mods) END AS governance_threshold,
    {pct_round('modification_counter', 'stats_rows', 28)} AS mod_ratio_percent,
    {pct_round('rows_sampled', 'stats_rows', 19)} AS actual_sample_percent,
    CAST(least(CASE WHEN legacy_ce THEN low * multiplier ELSE low END, 100) AS DECIMAL(19,6)) AS low_sample_limit_percent,
    CASE WHEN histogram_status <> 'AVAILABLE' OR histogram_status IS NULL OR dominant_percent IS NULL THEN 'UNKNOWN'
         WHEN dominant_percent >= extreme THEN 'EXTREME' WHEN dominant_percent >= high THEN 'HIGH'
         WHEN dominant_percent >= moderate THEN 'MODERATE' ELSE 'LOW' END AS skew_class
  FROM {source}),
d2 AS (
  SELECT *, stats_rows AS governance_basis_rows,
    CASE WHEN governance_threshold IS NULL OR modification_counter IS NULL THEN NULL
         ELSE greatest(governance_threshold - modification_counter, 0) END AS governance_remaining,
    {pct_cut('modification_counter', 'governance_threshold')} AS governance_progress_percent,
    modification_counter >= governance_threshold AS governance_reached,
    governance_threshold - native_threshold AS governance_native_delta,
    CASE WHEN governance_threshold < native_threshold THEN 'GOVERNANCE_EARLIER'
         WHEN governance_threshold > native_threshold THEN 'GOVERNANCE_LATER'
         WHEN governance_threshold = native_threshold THEN 'SAME_THRESHOLD' END AS governance_native_comparison,
    coalesce(actual_sample_percent < low_sample_limit_percent, false) AS low_sample_warning,
    dominant_percent AS histogram_dominant_percent, top3_percent AS histogram_top3_percent,
    CASE WHEN writable_primary IS DISTINCT FROM true THEN 'DATABASE_NOT_WRITABLE_PRIMARY'
         WHEN memory_optimized THEN 'MEMORY_OPTIMIZED_MANUAL_REVIEW_V1'
         WHEN temporary THEN 'TEMPORARY_STATISTIC_NOT_SUPPORTED'
         WHEN base_index_disabled OR index_disabled OR hypothetical THEN 'DISABLED_OR_HYPOTHETICAL_INDEX'
         WHEN index_type IN (5, 6) THEN 'COLUMNSTORE_INDEX_STATISTIC_DEFERRED'
         WHEN index_type = 3 THEN 'XML_INDEX_STATISTIC_DEFERRED'
         WHEN index_type = 4 THEN 'SPATIAL_INDEX_STATISTIC_DEFERRED'
         WHEN index_type = 7 THEN 'HASH_INDEX_STATISTIC_DEFERRED'
         WHEN index_type = 9 THEN 'JSON_INDEX_STATISTIC_DEFERRED'
         WHEN index_type IS NOT NULL AND index_type NOT IN (1, 2) THEN 'UNKNOWN_INDEX_FAMILY_DEFERRED'
         WHEN incremental THEN 'INCREMENTAL_PARTITION_EXECUTOR_DEFERRED_V1'
         WHEN o_action = 'EXCLUDE' THEN 'EXPLICIT_EXCLUSION'
         WHEN properties_available IS DISTINCT FROM true THEN 'STATISTICS_PROPERTIES_UNAVAILABLE'
         WHEN current_rows IS NULL THEN 'CURRENT_ROWCOUNT_UNAVAILABLE'
         WHEN current_rows = 0 THEN 'EMPTY_TABLE'
         WHEN current_rows < row_floor AND o_action IS NULL THEN 'BELOW_ROWCOUNT_FLOOR'
         WHEN stats_age_minutes < cooldown THEN 'UPDATE_COOLDOWN'
         WHEN o_force_update THEN 'APPROVED_FORCE_REFRESH'
         WHEN last_updated IS NULL THEN CASE WHEN has_filter THEN 'FILTERED_EMPTY_OR_UNINITIALIZED_REVIEW' ELSE 'MISSING_STATISTICS_BLOB' END
         WHEN modification_counter IS NULL THEN 'MODIFICATION_COUNTER_UNAVAILABLE'
         WHEN modification_counter < min_mods OR modification_counter = 0 THEN 'BELOW_MIN_MODIFICATIONS'
         WHEN stats_rows = 0 THEN 'ZERO_BASELINE_WITH_MODIFICATIONS'
         WHEN mod_ratio_percent >= threshold THEN 'MODIFICATION_THRESHOLD'
         ELSE 'BELOW_MODIFICATION_THRESHOLD' END AS ladder_reason
  FROM d1),
d3 AS (
  SELECT *,
    ladder_reason IN ('APPROVED_FORCE_REFRESH', 'MISSING_STATISTICS_BLOB', 'ZERO_BASELINE_WITH_MODIFICATIONS', 'MODIFICATION_THRESHOLD') AS e0,
    coalesce(o_persistence_mode, 'KEEP') AS pmode, coalesce(persisted_percent, 0) AS prate,
    coalesce(stats_rows, current_rows) AS size_rows
  FROM d2),
d4 AS (
  SELECT *,
    CASE WHEN o_action = 'FORCE_SAMPLE_ROWS' THEN
      CASE WHEN o_sample_rows IS NULL OR o_sample_rows <= 0 THEN 'INVALID_SAMPLE_ROWS_OVERRIDE'
           WHEN pmode = 'ON' THEN 'SAMPLE_ROWS_CANNOT_PERSIST_ROW_COUNT'
           WHEN prate > 0 AND pmode = 'KEEP' THEN 'ROW_SAMPLE_CONFLICTS_WITH_PERSISTED_PERCENT' END END AS revoke1,
    CASE WHEN o_action = 'FORCE_FULLSCAN' THEN 'FULLSCAN' WHEN o_action = 'FORCE_SAMPLE_PERCENT' THEN 'SAMPLE_PERCENT'
         WHEN o_action = 'FORCE_SAMPLE_ROWS' THEN 'SAMPLE_ROWS'
         WHEN prate > 0 AND supports_persist AND has_persist_metadata THEN 'KEPT'
         WHEN skew_enabled AND size_rows >= large AND skew_class IN ('HIGH', 'EXTREME') THEN 'SKEW'
         WHEN o_action IS NULL AND default_percent IS NOT NULL AND size_rows >= large THEN 'DEFAULT' ELSE 'AUTO' END AS branch
  FROM d3),
d5 AS (
  SELECT *,
    CASE branch WHEN 'KEPT' THEN 'SAMPLE_PERCENT' WHEN 'SKEW' THEN 'SAMPLE_ROWS' WHEN 'DEFAULT' THEN 'SAMPLE_PERCENT' ELSE branch END AS m5,
    CAST(CASE branch WHEN 'FULLSCAN' THEN 100 WHEN 'SAMPLE_PERCENT' THEN o_sample_percent WHEN 'KEPT' THEN persisted_percent
         WHEN 'DEFAULT' THEN default_percent END AS DECIMAL(19,6)) AS pct5,
    CASE WHEN branch = 'SAMPLE_ROWS' THEN CASE WHEN o_sample_rows > current_rows THEN current_rows ELSE o_sample_rows END
         WHEN branch = 'SKEW' AND skew_class = 'EXTREME' THEN CASE WHEN extreme_rows > current_rows THEN current_rows ELSE extreme_rows END
         WHEN branch = 'SKEW' THEN CASE WHEN high_rows > current_rows THEN current_rows ELSE high_rows END END AS rows5,
    CASE WHEN branch = 'SAMPLE_ROWS' AND o_sample_rows > current_rows THEN 'APPROVED_OVERRIDE_CAPPED_TO_ROWS'
         WHEN branch IN ('FULLSCAN', 'SAMPLE_PERCENT', 'SAMPLE_ROWS') THEN 'APPROVED_OVERRIDE'
         WHEN branch = 'KEPT' THEN 'EXISTING_PERSISTED_RATE'
         WHEN branch = 'SKEW' THEN skew_class || '_SKEW_SAMPLE_ROWS'
         WHEN branch = 'DEFAULT' THEN 'REQUESTED_LARGE_TABLE_SAMPLE' ELSE 'SQL_DEFAULT' END AS src5
  FROM d4),
d6 AS (
  SELECT *,
    CASE WHEN branch = 'SAMPLE_ROWS' AND pmode = 'OFF' THEN 0
         WHEN m5 NOT IN ('FULLSCAN', 'SAMPLE_PERCENT') THEN NULL
         WHEN branch = 'KEPT' OR pmode = 'ON' THEN 1
         WHEN pmode = 'OFF' THEN 0
         WHEN prate = 0 AND supports_persist THEN 0
         WHEN supports_persist = false THEN NULL
         WHEN abs(persisted_percent - pct5) <= 0.0001 THEN 1
         ELSE -1 END AS p6
  FROM d5),
d7 AS (
  SELECT *,
    e0 AND revoke1 IS NULL AND coalesce(p6, 0) <> -1 AS is_eligible,
    CASE WHEN e0 AND revoke1 IS NOT NULL THEN revoke1
         WHEN e0 AND p6 = -1 THEN 'PERSISTENCE_CONFLICT_REQUIRES_EXPLICIT_CHOICE' ELSE ladder_reason END AS reason,
    CASE p6 WHEN 1 THEN true WHEN 0 THEN false END AS p7
  FROM d6),
d8 AS (
  SELECT *,
    CASE WHEN NOT is_eligible THEN NULL
         WHEN supports_maxdop IS NULL THEN 'STATISTICS_MAXDOP_CAPABILITY_UNKNOWN'
         WHEN NOT supports_maxdop THEN 'STATISTICS_MAXDOP_NOT_SUPPORTED_ON_THIS_BUILD'
         WHEN p7 IS NULL THEN NULL
         WHEN supports_persist IS NULL THEN 'PERSIST_SAMPLE_CAPABILITY_UNKNOWN'
         WHEN NOT supports_persist THEN 'PERSIST_SAMPLE_OPTION_NOT_SUPPORTED_ON_THIS_BUILD'
         WHEN has_persist_metadata IS DISTINCT FROM true THEN 'PERSISTED_SAMPLE_METADATA_UNAVAILABLE' END AS capability_reason,
    CASE WHEN supports_persist AND rebuild_keeps = false THEN 'INDEX_REBUILD_CAN_RESET_PERSISTED_SAMPLE'
         WHEN supports_persist AND rebuild_keeps IS NULL THEN 'REBUILD_PERSISTENCE_BEHAVIOR_UNKNOWN'
         WHEN supports_persist = false THEN 'PERSISTED_SAMPLING_NOT_SUPPORTED_ON_THIS_BUILD' END AS persistence_advisory
  FROM d7),
decided AS (
  SELECT *,
    is_eligible AND capability_reason IS NULL AS can_execute,
    CASE WHEN is_eligible THEN m5 END AS collection_method,
    CASE WHEN is_eligible THEN pct5 END AS requested_sample_percent,
    CASE WHEN is_eligible THEN rows5 END AS requested_sample_rows,
    CASE WHEN is_eligible THEN src5 END AS sampling_source,
    CASE WHEN is_eligible THEN p7 END AS persist_option,
    e0 AND branch = 'FULLSCAN' AS fullscan_eligible,
    CASE WHEN e0 AND branch = 'FULLSCAN' THEN 'APPROVED_FORCE_FULLSCAN_OVERRIDE' END AS fullscan_reason
  FROM d8)"""


FACTS_POLICY = """
joined AS (
  SELECT n.*, p.*, w.override_id AS o_override_id, w.o_action, w.o_sample_percent, w.o_sample_rows,
    w.o_persistence_mode, w.o_force_update, w.o_expires_at
  FROM native n CROSS JOIN policy3 p LEFT JOIN winner w ON w.stats_id = n.stats_id)"""

DECIDED_FRAMES = ("fleet", "overrides", "policy")
DECIDED = (NATIVE, WINNER, _SETTINGS, FACTS_POLICY, decision_chain("joined"))
SETTINGS = _SETTINGS

__all__ = ["NOW", "NATIVE", "WINNER", "DECIDED", "DECIDED_FRAMES", "SETTINGS", "FACTS_POLICY", "decision_chain", "pct_cut", "pct_round", "cte"]
