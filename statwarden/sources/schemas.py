"""Contract schemas of the governance tables (name, Spark type, nullable)."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: columns in order; as Spark DDL
_COLUMNS = {
    "overrides": "override_id int NOT NULL, database_name string NOT NULL, schema_name string NOT NULL, table_name string NOT NULL, stat_name string, "
    "action string NOT NULL, sample_percent decimal(9,4), persistence_mode string NOT NULL, force_update boolean NOT NULL, is_enabled boolean NOT NULL, "
    "approved_by string NOT NULL, approved_at timestamp_ntz NOT NULL, expires_at timestamp_ntz, notes string NOT NULL, revision bigint NOT NULL, sample_rows bigint",
    "run_databases": "run_id string NOT NULL, database_name string NOT NULL, collection_status string NOT NULL, candidate_count int NOT NULL, environment string, "
    "error_number int, error_message string, database_id int, database_created_at timestamp_ntz, selection_status string, "
    "selection_reason string, scope_at_selection string, last_scope_status string, scope_at_last_check string, last_scope_check_at timestamp_ntz",
    "runs": "run_id string NOT NULL, engine_version string NOT NULL, mode string NOT NULL, started_at timestamp_ntz NOT NULL, heartbeat_at timestamp_ntz NOT NULL, "
    "finished_at timestamp_ntz, deadline_at timestamp_ntz, session_id int NOT NULL, original_login string NOT NULL, server_name string, "
    "product_version string, requested_maxdop int NOT NULL, parameters string NOT NULL, trace_flags string, run_status string NOT NULL, error_number int, error_message string",
    "scope": "database_name string NOT NULL, enabled boolean NOT NULL, approved_by string, approved_at timestamp_ntz, notes string NOT NULL, is_excluded boolean NOT NULL, "
    "exclusion_reason string, excluded_by string, excluded_at timestamp_ntz, revision bigint NOT NULL",
    "scope_audit": "scope_audit_id bigint NOT NULL, database_name string NOT NULL, change_type string NOT NULL, changed_at timestamp_ntz NOT NULL, changed_by string NOT NULL, "
    "session_id int NOT NULL, old_scope string, new_scope string",
    "settings": "settings_id tinyint NOT NULL, schema_version string NOT NULL, update_threshold_percent decimal(9,4) NOT NULL, min_modification_count bigint NOT NULL, "
    "min_update_interval_minutes int NOT NULL, lock_timeout_ms int NOT NULL, skew_sampling_enabled boolean NOT NULL, moderate_skew_percent decimal(9,4) NOT NULL, "
    "high_skew_percent decimal(9,4) NOT NULL, extreme_skew_percent decimal(9,4) NOT NULL, high_skew_sample_rows bigint NOT NULL, extreme_skew_sample_rows bigint NOT NULL",
    "telemetry": "telemetry_id bigint NOT NULL, run_id string NOT NULL, database_name string NOT NULL, schema_name string NOT NULL, table_name string NOT NULL, stat_name string NOT NULL, "
    "object_id int NOT NULL, stats_id int NOT NULL, override_id int, initial_snapshot string NOT NULL, initial_override string, initial_decision string NOT NULL, "
    "revalidated_snapshot string, revalidated_override string, revalidated_decision string, after_snapshot string, recommended_command string, "
    "executed_command string, action_id int, execution_status string NOT NULL, execution_reason string, command_started_at timestamp_ntz, "
    "command_ended_at timestamp_ntz, command_elapsed_ms bigint, error_number int, error_message string, postcheck_status string, "
    "postcheck_error_number int, postcheck_error_message string",
    "action_log": "action_id int NOT NULL, database_name string, schema_name string, object_name string, object_type string, index_name string, "
    "index_type tinyint, statistics_name string, partition_number int, extended_info string, command string NOT NULL, command_type string NOT NULL, "
    "start_time timestamp_ntz NOT NULL, end_time timestamp_ntz, error_number int, error_message string",
}


def contract() -> dict[str, T.StructType]:
    return {name: T.StructType.fromDDL(text) for name, text in _COLUMNS.items()}
