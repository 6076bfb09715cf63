"""Input frames derived from the given tables (see FIXTURES.md, part C).

``STAGES`` holds, per frame, the source and the column expressions; each stage
may use the columns of the stage before. ``frame`` builds the Spark DataFrame,
``cte`` the DuckDB text of the same frame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from statwarden.plans.dialect import Duck, Spark

AS_OF = "2024-01-15 12:00:00"


def _name(dataset_id: str) -> str:
    return (
        f"CASE {dataset_id} WHEN 1 THEN 'master' WHEN 2 THEN 'tempdb' WHEN 3 THEN 'model' WHEN 4 THEN 'msdb' "
        f"WHEN 5 THEN 'SSISDB' WHEN 6 THEN 'GovernanceDb' ELSE 'Db_' || CAST({dataset_id} AS STRING) END"
    )


def _environment(d, m: str) -> dict[str, str]:
    """Database-level settings as a function of the customer key."""
    return {
        "compat_level": f"CAST(110 + 10 * ({m} % 7) AS INT)",
        "product_major": f"CAST(12 + {m} % 6 AS INT)",
        "engine_edition": f"CASE WHEN {m} % 19 = 0 THEN 8 ELSE 3 END",
        "scoped_legacy": f"CASE WHEN {m} % 11 = 0 THEN NULL ELSE {m} % 5 = 0 END",
        "legacy_flag": f"({m} % 13 = 0)",
        "modern_flag": f"({m} % 17 = 0)",
        "dynamic_flag": f"({m} % 23 = 0)",
        "auto_update_on": f"({m} % 9 <> 0)",
        "auto_update_async": f"({m} % 4 = 0)",
        "query_store_state": f"CASE WHEN {m} % 6 = 0 THEN NULL ELSE "
        + d.pick(["'READ_WRITE'", "'READ_ONLY'", "'OFF'"], f"{m} % 3")
        + " END",
        "supports_wait_stats": f"CASE WHEN {m} % 10 = 0 THEN NULL ELSE {m} % 8 <> 0 END",
        "supports_ce_feedback": f"CASE WHEN {m} % 12 = 0 THEN NULL ELSE {m} % 5 <> 0 END",
        "ce_feedback_setting": f"CASE WHEN {m} % 14 = 0 THEN NULL ELSE {m} % 4 <> 1 END",
        "database_scoped_maxdop": f"CASE WHEN {m} % 15 = 0 THEN NULL ELSE CAST({m} % 9 AS INT) END",
        "server_maxdop": f"CAST({m} % 16 AS INT)",
    }


def _stages(d) -> dict[str, tuple[str, list[dict[str, str]]]]:
    as_of = d.ts(AS_OF)
    fleet = [
        {"k": "o_orderkey", "m": "o_custkey"},
        {
            "database_id": "m + 1",
            "database_name": _name("(m + 1)"),
            "schema_name": "'schema_' || CAST(m % 5 AS STRING)",
            "object_id": "(m * 3 + k % 3) % 100",
            "table_name": "'T' || CAST(m * 3 + k % 3 AS STRING)",
            "stats_id": "k",
            "stat_name": "'S' || CAST(k AS STRING)",
            "created_at": d.plus_days(d.ts("2020-01-01 00:00:00"), "m % 1000"),
            "index_type": "CAST(CASE WHEN k % 16 <= 4 THEN NULL WHEN k % 16 IN (5, 6, 7, 8, 14) THEN 1 WHEN k % 16 = 13 THEN "
            + d.pick(["3", "4", "5", "6", "7", "8", "9", "2"], d.div("k", "16") + " % 8")
            + " ELSE 2 END AS INT)",
            "base_index_type": "CAST(CASE WHEN m % 6 = 0 THEN 5 WHEN m % 2 = 0 THEN 1 ELSE 0 END AS INT)",
            "has_filter": "(k % 5 = 0)",
            "never_updated": "(k % 61 = 0)",
            "legacy_ce": "(k % 3 = 0)",
            "stats_rows": "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 0 ELSE (k % 1000 + 1) * (m % 50 + 1) * 997 END",
            "memory_optimized": "(k % 67 = 0)",
            "temporary": "(k % 71 = 0)",
            "base_index_disabled": "(k % 73 = 0)",
            "index_disabled": "(k % 79 = 0)",
            "hypothetical": "(k % 83 = 0)",
            "incremental": "(k % 89 = 0)",
            "writable_primary": "(k % 97 <> 0)",
            "properties_available": "(k % 101 <> 0)",
            "histogram_status": "CASE WHEN k % 7 = 0 THEN 'NO_HISTOGRAM_ROWS' ELSE 'AVAILABLE' END",
            "dominant_percent": "CAST(CAST(k % 400 AS DECIMAL(9,0)) * 0.1 AS DECIMAL(19,6))",
            "top3_percent": "CAST(CAST(k % 400 AS DECIMAL(9,0)) * 0.2 AS DECIMAL(19,6))",
            "supports_maxdop": "CASE WHEN k % 103 = 0 THEN NULL ELSE k % 107 <> 0 END",
            "supports_persist": "CASE WHEN k % 109 = 0 THEN NULL ELSE k % 113 <> 0 END",
            "rebuild_keeps": "CASE WHEN k % 131 = 0 THEN false WHEN k % 23 = 0 THEN NULL ELSE true END",
            "has_persist_metadata": "(k % 127 <> 0)",
            "persisted_percent": "CAST(CASE WHEN k % 127 = 0 THEN NULL WHEN k % 17 = 0 THEN 20 WHEN k % 19 = 0 THEN 100 ELSE 0 END AS DECIMAL(19,6))",
            "no_recompute": "(k % 33 = 0)",
            "is_ms_shipped": "(k % 29 = 0)",
            "is_external": "(k % 139 = 0)",
            **_environment(d, "m"),
        },
        {
            "auto_created": "(index_type IS NULL AND k % 2 = 0)",
            "user_created": "(index_type IS NULL AND k % 2 = 1)",
            "unfiltered_rows": "CASE WHEN has_filter THEN stats_rows * 2 ELSE stats_rows END",
            "current_rows": "CASE WHEN k % 43 = 0 THEN NULL WHEN k % 47 = 0 THEN 0 ELSE coalesce(stats_rows, 1000) + (k % 100) * 10 END",
            "rows_sampled": d.div("stats_rows * (k % 100 + 1)", "1000"),
            "modification_counter": "CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 0 "
            "WHEN coalesce(stats_rows, 0) = 0 THEN k % 2000 ELSE " + d.div("stats_rows * (k % 31)", "100") + " END",
            "last_updated": f"CASE WHEN never_updated THEN NULL ELSE {d.minus_seconds(as_of, '(k % 29) * 1200 + k % 60')} END",
        },
    ]
    overrides = [
        {"k": "o_orderkey", "m": "o_custkey"},
        {"a": d.div("k", "13") + " % 7"},
        {
            "override_id": "k + 1",
            "database_name": _name("(m + 1)"),
            "schema_name": "'schema_' || CAST(m % 5 AS STRING)",
            "table_name": "'T' || CAST(m * 3 + k % 3 AS STRING)",
            "stat_name": "CASE WHEN k % 13 = 0 THEN 'S' || CAST(k AS STRING) END",
            "action": "CASE WHEN k % 13 <> 0 THEN CASE WHEN m % 34 = 0 THEN 'EXCLUDE' ELSE 'REFRESH_AUTO' END ELSE "
            + d.pick(
                [
                    "'EXCLUDE'", "'FORCE_FULLSCAN'", "'FORCE_SAMPLE_PERCENT'", "'FORCE_SAMPLE_ROWS'",
                    "'REFRESH_AUTO'", "'FORCE_SAMPLE_ROWS'", "'FORCE_FULLSCAN'",
                ],
                "a",
            )
            + " END",
            "persistence_mode": "CASE WHEN k % 13 <> 0 OR a IN (0, 4) THEN 'KEEP' ELSE "
            + d.pick(["'KEEP'", "'ON'", "'OFF'"], d.div("k", "91") + " % 3")
            + " END",
            "force_update": f"(k % 13 = 0 AND {d.div('k', '7')} % 2 = 0 AND a <> 0)",
            "sample_percent": "CASE WHEN k % 13 = 0 AND a = 2 THEN CAST(20 AS DECIMAL(9,4)) END",
            "sample_rows": "CASE WHEN k % 13 <> 0 THEN NULL WHEN a = 3 THEN 25000 WHEN a = 5 THEN CASE WHEN k % 2 = 0 THEN 0 ELSE 1000000000 END END",
            "expires_at": f"CASE WHEN k % 13 <> 0 THEN NULL WHEN {d.div('k', '3')} % 11 = 0 THEN {d.ts('2024-01-01 00:00:00')} "
            f"WHEN {d.div('k', '7')} % 2 = 0 THEN {d.ts('2024-02-01 00:00:00')} END",
            "is_enabled": f"(k % 13 <> 0 OR {d.div('k', '5')} % 19 <> 0)",
            "approved_at": d.ts("2024-01-10 00:00:00"),
            "approved_by": "CASE WHEN k % 211 = 0 THEN ' ' ELSE 'reviewer_' || CAST(k % 9 AS STRING) END",
            "notes": "CASE WHEN k % 223 = 0 THEN '  ' ELSE 'ticket ' || CAST(k AS STRING) END",
        },
    ]
    datasets = [
        {"m": "c_custkey", "id": "c_custkey + 1"},
        {
            "database_id": "id",
            "database_name": _name("id"),
            "state": "CASE WHEN id % 100 = 9 THEN 'OFFLINE' ELSE 'ONLINE' END",
            "is_distributor": "(id % 100 = 10)",
            "is_snapshot": "(id % 100 = 11)",
            "is_accessible": "(id % 100 <> 12)",
            "is_primary": "CASE WHEN id % 100 = 13 THEN false WHEN id % 100 = 14 THEN true END",
            "created_at": d.plus_days(d.ts("2020-01-01 00:00:00"), "m % 1000"),
            "writable_primary": "(id % 100 <> 13)",
            "auto_create_on": "(id % 7 <> 0)",
            **_environment(d, "m"),
        },
    ]
    datasets_now = [
        *datasets,
        {
            "now_name": "CASE WHEN id % 50 = 16 THEN database_name || '_renamed' ELSE database_name END",
            "now_created": f"CASE WHEN id % 50 = 15 THEN {d.ts('2023-12-31 00:00:00')} ELSE created_at END",
            "now_state": "CASE WHEN id % 50 = 17 THEN 'OFFLINE' ELSE state END",
        },
    ]
    scope = [
        {"id": "c_custkey + 1"},
        {
            "configured_name": f"CASE WHEN id % 50 = 17 THEN 'NoSuchDb_' || CAST(id AS STRING) WHEN id % 30 = 7 THEN lower({_name('id')}) ELSE {_name('id')} END",
            "is_excluded": "(id % 3 = 0 AND id % 2 = 0)",
            "enabled": "(id % 3 = 0 AND id % 2 = 1)",
            "exclusion_reason": "CASE WHEN id % 6 = 0 AND id % 60 <> 30 THEN 'maintained elsewhere' END",
            "excluded_by": "CASE WHEN id % 6 = 0 THEN 'owner_' || CAST(id % 7 AS STRING) END",
            "excluded_at": f"CASE WHEN id % 6 = 0 THEN {d.ts('2024-01-05 00:00:00')} END",
            "approved_by": "CASE WHEN id % 6 = 3 AND id % 90 <> 45 THEN 'owner_' || CAST(id % 7 AS STRING) END",
            "approved_at": f"CASE WHEN id % 6 = 3 THEN {d.ts('2024-01-06 00:00:00')} END",
            "notes": "CASE WHEN id % 30 = 21 THEN '  ' ELSE 'note ' || CAST(id AS STRING) END",
            "revision": "id * 7",
        },
    ]
    scope_alias = [
        scope[0],
        {
            "configured_name": f"lower({_name('id')})",
            "is_excluded": "false",
            "enabled": "false",
            "exclusion_reason": "CAST(NULL AS STRING)",
            "excluded_by": "CAST(NULL AS STRING)",
            "excluded_at": f"CASE WHEN false THEN {as_of} END",
            "approved_by": "CAST(NULL AS STRING)",
            "approved_at": f"CASE WHEN false THEN {as_of} END",
            "notes": "'alias ' || CAST(id AS STRING)",
            "revision": "id * 7 + 1",
        },
    ]
    scope_requests = [
        {"id": "c_custkey + 1"},
        {
            "requested_name": f"CASE WHEN id % 20 = 0 THEN '  ' || upper({_name('id')}) || ' ' ELSE {_name('id')} END",
            "is_excluded": d.pick(["CAST(NULL AS BOOLEAN)", "true", "false"], "id % 3"),
            "enabled": d.pick(["CAST(NULL AS BOOLEAN)", "true", "false"], d.div("id", "3") + " % 3"),
            "notes": "CASE WHEN id % 8 = 0 THEN '   ' ELSE ' change ' || CAST(id AS STRING) || ' ' END",
            "requested_by": "'operator_' || CAST(id % 4 AS STRING)",
        },
    ]
    settings = [
        {"id": "c_custkey + 1"},
        {
            "database_id": "id",
            "settings_id": "CASE WHEN id % 64 = 0 THEN 2 ELSE 1 END",
            "schema_version": "CASE WHEN id % 40 = 0 THEN '1.2.0' ELSE '1.3.0' END",
            "update_threshold_percent": "CAST(CASE WHEN id % 45 = 0 THEN 0 ELSE 10 + id % 3 END AS DECIMAL(9,4))",
            "min_modification_count": "CASE WHEN id % 55 = 0 THEN -1 ELSE 500 + id % 7 END",
            "min_update_interval_minutes": "60",
            "lock_timeout_ms": "CAST(CASE WHEN id % 35 = 0 THEN 700000 ELSE 5000 END AS INT)",
            "skew_sampling_enabled": "(id % 2 = 0)",
            "moderate_skew_percent": "CAST(CASE WHEN id % 25 = 0 THEN 11 ELSE 5 END AS DECIMAL(9,4))",
            "high_skew_percent": "CAST(10 AS DECIMAL(9,4))",
            "extreme_skew_percent": "CAST(CASE WHEN id % 65 = 0 THEN 101 ELSE 25 END AS DECIMAL(9,4))",
            "high_skew_sample_rows": "CAST(5000000 AS BIGINT)",
            "extreme_skew_sample_rows": "CAST(CASE WHEN id % 75 = 0 THEN 1000 ELSE 10000000 END AS BIGINT)",
        },
    ]
    versions = [
        {"id": "c_custkey", "case_no": "c_custkey % 20"},
        {
            # fixed values: the sixteen documented builds and four malformed ones
            "product_version": d.pick(
                [
                    "'13.0.1601.5'", "'13.0.4422.0'", "'13.0.4435.0'", "'13.0.4446.0'", "'13.0.5026.0'",
                    "'13.0.5888.11'", "'14.0.1000.169'", "'14.0.3006.16'", "'14.0.3008.27'", "'14.0.3015.40'",
                    "'14.0.3411.3'", "'15.0.2000.5'", "'15.0.4123.1'", "'16.0.1000.6'", "'17.0.4085.5'",
                    "'12.0.2000.8'", "'13.0.5026'", "'12.0.2000.8'", "'abc'", "'14.0.999.1'",
                ],
                "case_no",
            ),
            "engine_edition": "CASE WHEN case_no = 15 THEN 8 WHEN id % 3 = 0 THEN 2 ELSE 3 END",
        },
    ]
    # object n of the whole fleet is in database n div 3 + 1; its own id repeats every 100
    _div3 = d.div("l_suppkey", "3") + " + 1"
    partition_rows = [
        {"database_id": _div3, "object_id": "l_suppkey % 100", "partition_number": "l_linenumber", "index_id": "l_linenumber % 3", "row_count": "1"},
    ]
    row_groups = [
        {
            "database_id": _div3,
            "object_id": "l_suppkey % 100",
            "index_id": "1 + l_linenumber % 2",
            "partition_number": "l_linenumber",
            "state": "CAST(1 + l_orderkey % 4 AS INT)",
            "total_rows": "l_partkey * 10",
            "deleted_rows": "least(l_partkey * 10, CAST(l_quantity AS BIGINT))",
        },
    ]
    changes = [
        {"event_id": "event_id", "event_type": "event_type", "user_id": "user_id", "ts": "ts"},
    ]
    after = [
        *fleet,
        {
            "after_found": "(k % 149 <> 0)",
            "after_rows": "current_rows",
            "after_rows_sampled": "current_rows",
            "after_persisted": "CASE WHEN k % 151 = 0 THEN CAST(55 AS DECIMAL(19,6)) WHEN k % 17 = 0 THEN CAST(20 AS DECIMAL(19,6)) ELSE CAST(0 AS DECIMAL(19,6)) END",
            "after_last_updated": f"CASE WHEN k % 43 = 0 OR k % 157 = 0 THEN NULL ELSE {as_of} END",
        },
    ]
    fresh = [
        *fleet,
        {
            "fresh_found": "(k % 149 <> 0)",
            "fresh_created_at": f"CASE WHEN k % 157 = 0 THEN {d.ts('2024-01-14 00:00:00')} ELSE created_at END",
            "fresh_stat_name": "CASE WHEN k % 163 = 0 THEN stat_name || '_new' ELSE stat_name END",
            "fresh_mods": "CASE WHEN k % 11 = 0 THEN 0 ELSE modification_counter END",
            "fresh_supports_maxdop": "CASE WHEN k % 31 = 0 THEN false ELSE supports_maxdop END",
        },
    ]
    names = [
        {
            "p_partkey": "p_partkey",
            "two_part": "'[' || p_brand || '].' || p_type",
            "dotted": "CASE p_partkey % 6 WHEN 0 THEN p_brand || '.a.b.' || p_type WHEN 1 THEN p_brand || '.b' WHEN 2 THEN 'x..' || p_brand "
            "WHEN 3 THEN 'a.b.c.d.' || p_brand WHEN 4 THEN '[odd.' || p_brand || '].[na]]me]' ELSE p_brand END",
            "listed": "CASE p_partkey % 5 WHEN 0 THEN p_brand || ',, ' || p_type WHEN 1 THEN ' ' || p_brand || ' , ' || p_type || ' ' "
            "WHEN 2 THEN p_brand || ',' WHEN 3 THEN ',' || p_type ELSE p_brand || ',' || p_type || ',' || p_name END",
            "raw_name": "CASE WHEN p_partkey % 10 = 0 THEN p_brand || ']' || p_type WHEN p_partkey % 77 = 0 THEN repeat(p_name, 20) ELSE p_name END",
            "p_brand": "p_brand", "p_type": "p_type", "p_name": "p_name",
        },
    ]
    runs = [
        {"run_no": "o_orderkey", "m": "o_custkey"},
        {
            "mode": d.pick(["'OBSERVE'", "'RECOMMEND'", "'ENFORCE'"], "run_no % 3"),
            "engine_version": d.pick(["'1.3.0'", "'1.3.1'", "'1.3.2'"], d.div("run_no", "3") + " % 3"),
            "started_at": d.minus_seconds(as_of, "(run_no % 9973) * 61"),
            "database_name": _name("(m + 1)"),
        },
    ]
    cat_stats = [
        {"k": "o_orderkey", "m": "o_custkey"},
        {
            "database_id": "m + 1",
            "object_id": "(m * 3 + k % 3) % 100",
            "stats_id": "k + 10",
            "stat_name": "'S' || CAST(k AS STRING)",
            "auto_created": "(k % 16 <= 4 AND k % 2 = 0)",
            "user_created": "(k % 16 <= 4 AND k % 2 = 1)",
            "no_recompute": "(k % 33 = 0)",
            "has_filter": "(k % 5 = 0)",
            "leading_column_id": "CAST(1 + k % 4 AS INT)",
        },
    ]
    cat_indexes = [
        {"k": "o_orderkey", "m": "o_custkey"},
        {
            "database_id": "m + 1",
            "object_id": "(m * 3 + k % 3) % 100",
            "index_id": "k + 10",
            "index_name": "'IX_' || CAST(k AS STRING)",
            "index_type": "CAST(CASE WHEN k % 16 IN (5, 6, 7, 8, 14) THEN 1 WHEN k % 16 = 13 THEN "
            + d.pick(["3", "4", "5", "6", "7", "8", "9", "2"], d.div("k", "16") + " % 8")
            + " ELSE 2 END AS INT)",
            "is_disabled": "(k % 79 = 0)",
            "is_hypothetical": "(k % 83 = 0)",
        },
    ]
    cat_tables = [
        {"m": "c_custkey", "j": d.explode_range(3)},
        {
            "database_id": "m + 1",
            "database_name": _name("(m + 1)"),
            "object_id": "(m * 3 + j) % 100",
            "fleet_table_id": "m * 3 + j",
            "schema_id": "CAST(m % 5 AS INT)",
            "table_name": "'T' || CAST(m * 3 + j AS STRING)",
            "is_ms_shipped": "((m * 3 + j) % 29 = 0)",
            "is_external": "((m * 3 + j) % 31 = 0)",
            "is_memory_optimized": "((m * 3 + j) % 67 = 0)",
            "base_index_type": "CAST(CASE WHEN m % 6 = 0 THEN 5 WHEN m % 2 = 0 THEN 1 END AS INT)",
            "base_disabled": "((m * 3 + j) % 73 = 0)",
        },
    ]
    cat_schemas = [
        {"m": "c_custkey", "schema_id": d.explode_range(5)},
        {"database_id": "m + 1", "schema_name": "'schema_' || CAST(schema_id AS STRING)"},
    ]
    cat_columns = [
        {"m": "c_custkey", "j": d.explode_range(12)},
        {"database_id": "m + 1", "object_id": f"(m * 3 + {d.div('j', '4')}) % 100", "column_id": "CAST(1 + j % 4 AS INT)"},
        {
            "column_name": "'col_' || CAST(column_id AS STRING)",
            "data_type": d.pick(["'int'", "'nvarchar'", "'datetime2'", "'decimal'"], "j % 4"),
            "is_nullable": "(j % 3 = 0)",
        },
    ]
    cat_expected = [
        {"m": "c_custkey", "j": d.explode_range(15)},
        {"database_id": "m + 1", "object_id": f"(m * 3 + {d.div('j', '5')}) % 100", "column_id": "CAST(1 + j % 5 AS INT)"},
        {
            "column_name": "'col_' || CAST(column_id AS STRING)",
            "data_type": "CASE WHEN (object_id * 4 + column_id) % 89 = 0 THEN 'bigint' ELSE "
            + d.pick(["'int'", "'nvarchar'", "'datetime2'", "'decimal'", "'bit'"], f"({d.div('j', '5')} * 4 + column_id - 1) % 4 + {d.div('column_id', '5')} * 4")
            + " END",
            "is_nullable": f"(({d.div('j', '5')} * 4 + column_id - 1) % 3 = 0)",
            "wanted": "(column_id <= 4 AND (object_id * 4 + column_id) % 97 <> 0) OR (column_id = 5 AND object_id % 50 = 0)",
        },
    ]
    target_requests = [
        {"m": "c_custkey"},
        {
            "schema_name": "CASE WHEN m % 2 = 0 THEN 'SCHEMA_' ELSE 'schema_' END || CAST(m % 5 AS STRING)",
            "table_name": "CASE WHEN m % 3 = 0 THEN 't' ELSE 'T' END || CAST(m * 3 + m % 4 AS STRING)",
        },
    ]
    return {
        "cat_stats": ("orders", cat_stats),
        "cat_indexes": ("orders WHERE o_orderkey % 16 > 4", cat_indexes),
        "cat_tables": ("customer", cat_tables),
        "cat_schemas": ("customer", cat_schemas),
        "cat_columns": ("customer", cat_columns),
        "cat_expected": ("customer", cat_expected),
        "target_requests": ("customer", target_requests),
        "fleet": ("orders", fleet),
        "overrides": ("orders WHERE o_orderkey % 13 = 0 OR (o_custkey % 17 = 0 AND o_orderkey % 11 = 3)", overrides),
        "datasets": ("customer", datasets),
        "datasets_now": ("customer WHERE c_custkey % 50 <> 17", datasets_now),
        "scope_main": ("customer WHERE (c_custkey + 1) % 3 = 0 OR (c_custkey + 1) % 30 = 7 OR (c_custkey + 1) % 50 = 17", scope),
        "scope_alias": ("customer WHERE (c_custkey + 1) % 30 = 9", scope_alias),
        "scope_requests": ("customer", scope_requests),
        "settings": ("customer", settings),
        "versions": ("customer", versions),
        "partition_rows": ("lineitem", partition_rows),
        "row_groups": ("lineitem", row_groups),
        "changes": ("events", changes),
        "after": ("orders", after),
        "fresh": ("orders", fresh),
        "names": ("part", names),
        "runs": ("orders", runs),
    }


@lru_cache(maxsize=None)
def _cached(dialect):
    return _stages(dialect)


def frame(name: str, load: Callable[[str], DataFrame]) -> DataFrame:
    """The Spark frame; ``load`` gives the table it is derived from."""
    if name == "scope":
        return frame("scope_main", load).unionByName(frame("scope_alias", load))
    source, stages = _cached(Spark)[name]
    table, _, condition = source.partition(" WHERE ")
    df = load(table)
    if condition:
        df = df.where(condition)
    for i, stage in enumerate(stages):
        exprs = [f"{expr} AS {col}" for col, expr in stage.items()]
        df = df.selectExpr(*exprs) if i == 0 else df.selectExpr("*", *exprs)
    return df


def policies(spark: SparkSession) -> DataFrame:
    """The three fixture policies; a constant relation, so always safe to broadcast."""
    return spark.sql(POLICY_SQL)


# fixed values: three policies, one per mode
POLICY_SQL = """
SELECT * FROM VALUES
 (1, 'ENFORCE',   CAST(1000000 AS BIGINT), false, CAST(NULL AS DECIMAL(9,4))),
 (2, 'RECOMMEND', CAST(1000000 AS BIGINT), true,  CAST(NULL AS DECIMAL(9,4))),
 (3, 'OBSERVE',   CAST(0 AS BIGINT),       false, CAST(5 AS DECIMAL(9,4)))
 AS p(policy_id, mode, row_floor, skew_enabled, default_percent)
"""


def cte(name: str) -> str:
    """DuckDB text of a frame, without the surrounding WITH."""
    if name == "policy":
        return "policy AS (" + POLICY_SQL.replace("SELECT * FROM VALUES", "SELECT * FROM (VALUES").replace(" AS p(", ") AS p(") + ")"
    if name == "scope":
        return f"{cte('scope_main')}, {cte('scope_alias')}, scope AS (SELECT * FROM scope_main UNION ALL SELECT * FROM scope_alias)"
    source, stages = _cached(Duck)[name]
    text = source
    for i, stage in enumerate(stages):
        cols = ", ".join(f"{expr} AS {col}" for col, expr in stage.items())
        star = "" if i == 0 else "*, "
        body = f"SELECT {star}{cols} FROM {text}"
        text = f"({body})"
    return f"{name} AS {text}"
