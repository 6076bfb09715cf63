"""Statuses of planned work, re-validation, post-checks and run roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c, Fields, first_match, holds
from statwarden.operators.decision import PERCENT_TOLERANCE
from statwarden.operators.prefix import ROWS_PER_BUCKET, rows_before


def initial_status(mode: Column, eligible: Column, can_execute: Column) -> Column:
    return first_match(
        [
            (mode == "OBSERVE", "OBSERVED"),
            (~eligible, "DEFERRED"),
            (~can_execute, "BLOCKED_CAPABILITY"),
            (mode == "RECOMMEND", "RECOMMENDED"),
        ],
        "PENDING",
    )


def window_cutoff(
    items: DataFrame, budget: str = "budget_seconds", rows_per_bucket: int = ROWS_PER_BUCKET, order: Sequence[str] = ("item_id",)
) -> DataFrame:
    """Soft deadline: items (run_id, cost_seconds and the columns of ``order``) start in order until the
    costs before them use up the budget; the rest is not started. NULL = no limit."""
    df = rows_before(items, ["run_id"], order, "cost_seconds", "seconds_before", rows_per_bucket)
    late = holds(F.col("seconds_before") >= F.col(budget))
    return df.select(
        "*",
        F.when(late, F.lit("NOT_STARTED_WINDOW")).otherwise(F.lit("PENDING")).alias("execution_status"),
        F.when(late, F.lit("MAINTENANCE_DEADLINE")).alias("execution_reason"),
    )


def revalidation_error(f: Fields) -> Column:
    """Rule broken by the fresh snapshot: gone (51041) or not the same object (51042)."""
    changed = (
        (f.fresh_database_id != f.database_id)
        | (f.fresh_schema_name != f.schema_name)
        | (f.fresh_table_name != f.table_name)
        | (f.fresh_stat_name != f.stat_name)
        | (f.fresh_created_at != f.created_at)
    )
    return first_match([(~holds(f.fresh_found), 51041), (changed, 51042)], F.lit(None).cast("int"))


def revalidated_status(error: Column, eligible: Column, can_execute: Column) -> Column:
    """State after the second look; work that passes stays PENDING."""
    return first_match(
        [
            (error.isNotNull(), "SKIPPED_REVALIDATION_ERROR"),
            (~eligible, "SKIPPED_REVALIDATED"),
            (~can_execute, "BLOCKED_CAPABILITY"),
        ],
        "PENDING",
    )


def postcheck_status(found: Column, last_updated: Column, persist: Column, wanted: Column, persisted: Column) -> Column:
    off_rate = persisted.isNull() | (F.abs(persisted - wanted) > F.lit(PERCENT_TOLERANCE))
    not_cleared = persisted.isNull() | (persisted != 0)
    return first_match(
        [
            (~holds(found), "STATISTIC_NOT_FOUND"),
            (last_updated.isNull(), "NO_STATISTICS_BLOB"),
            (persist & off_rate, "PERSISTENCE_VALIDATION_FAILED"),
            (~persist & not_cleared, "PERSISTENCE_VALIDATION_FAILED"),
        ],
        "METADATA_COLLECTED",
    )


def database_status(d: Fields) -> Column:
    """Collection status of a database from what happened to it.

    Columns: is_excluded, aborted, failed, reached (the loop got to it before the
    deadline), gate_reason before collection, collected, cut_by_window, cut_by_scope.
    """
    before = holds(d.gate_reason != "SCOPE_ALLOWED")
    return first_match(
        [
            (d.is_excluded, "SKIPPED_EXCLUDED"),
            (d.failed, "FAILED"),
            (d.collected & d.cut_by_window, "PARTIAL_WINDOW"),
            (d.collected & d.cut_by_scope, "PARTIAL_SCOPE_CHANGE"),
            (d.collected, "COLLECTED"),
            (before & (d.gate_reason == "DATABASE_EXCLUDED"), "SKIPPED_EXCLUDED"),
            (before, "SKIPPED_SCOPE_BLOCKED"),
            (d.aborted, "NOT_COLLECTED_RUN_ABORTED"),
            (~d.reached, "NOT_COLLECTED_WINDOW"),
        ],
        "PENDING",
    )


def run_status(errors: Column, selected: Column, blocked: Column, window_expired: Column, warnings: Column) -> Column:
    return first_match(
        [
            (errors > 0, "COMPLETED_WITH_ERRORS"),
            (selected == 0, "NO_DATABASES_TO_PROCESS"),
            (blocked > 0, "COMPLETED_WITH_BLOCKED_ACTIONS"),
            (window_expired, "WINDOW_EXPIRED"),
            (warnings > 0, "COMPLETED_WITH_WARNINGS"),
        ],
        "COMPLETED",
    )


def is_blocked(mode: Column, status: Column, eligible: Column, can_execute: Column) -> Column:
    """Counted as blocked: by status when enforcing, by decision when reporting."""
    return F.when(mode == "ENFORCE", status == "BLOCKED_CAPABILITY").otherwise(eligible & ~can_execute)


# fixed values: statuses that count as errors of a run
ERROR_STATUSES = ("FAILED", "SKIPPED_REVALIDATION_ERROR")


def run_summary(telemetry: DataFrame, run_databases: DataFrame) -> DataFrame:
    """One row per run with its counters and final status.

    Both sides are reduced to one row per run (and database) before they meet, so
    the size of a run does not matter.
    """
    allowed = run_databases.select("run_id", "database_name", "last_scope_status")
    blocked = is_blocked(F.col("mode"), F.col("execution_status"), F.col("is_eligible"), F.col("can_execute"))
    per_database = telemetry.groupBy("run_id", "database_name").agg(
        F.count_if(F.col("execution_status").isin(*ERROR_STATUSES)).alias("errors"),
        F.count_if(blocked).alias("blocked"),
        F.count_if(F.col("postcheck_status") != "METADATA_COLLECTED").alias("warnings"),
        F.count_if(F.col("execution_status") == "NOT_STARTED_WINDOW").alias("late"),
    )
    work = (
        per_database.join(allowed, ["run_id", "database_name"], "left")
        .groupBy("run_id")
        .agg(
            F.sum("errors").alias("errors"),
            F.sum(F.when(F.col("last_scope_status") == "ALLOWED", F.col("blocked")).otherwise(0)).alias("blocked"),
            F.sum("warnings").alias("warnings"),
            F.sum("late").alias("late"),
        )
    )
    scope = run_databases.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requested_databases"),
        F.count_if(F.col("selection_status") != "EXCLUDED").alias("selected_databases"),
        F.count_if(F.col("selection_status") == "EXCLUDED").alias("initially_excluded_databases"),
        F.count_if(F.col("last_scope_status") == "EXCLUDED").alias("excluded_databases"),
        F.count_if(F.col("last_scope_status").isin("SCOPE_CHECK_FAILED", "APPROVAL_REVOKED", "DATABASE_UNAVAILABLE")).alias("gate_errors"),
    )
    df = scope.join(work, "run_id", "left")

    def count(name):
        return F.coalesce(F.col(name), F.lit(0))

    errors = count("errors") + F.col("gate_errors")
    return df.select(
        "run_id",
        errors.alias("error_count"),
        count("blocked").alias("blocked_count"),
        count("warnings").alias("postcheck_failures"),
        "requested_databases",
        "selected_databases",
        "initially_excluded_databases",
        "excluded_databases",
        run_status(errors, F.col("selected_databases"), count("blocked"), count("late") > 0, count("warnings")).alias("run_status"),
    )


def latest_actions(events: DataFrame) -> DataFrame:
    """Present state of each logged action from its started and finished events.

    The rows of one action are merged map-side; no window over the whole log.
    """
    payload = [c for c in events.columns if c not in ("action_id", "seq")]
    latest = events.groupBy("action_id").agg(
        F.max_by(F.struct("seq", *payload), "seq").alias("last"), F.min("event_at").alias("started_at")
    )
    return latest.select("action_id", "last.*", "started_at")


def report_only_violations(telemetry: DataFrame, actions: DataFrame) -> DataFrame:
    """Report modes must log nothing; enforcement exactly one action per attempt."""
    logged = actions.groupBy("run_id", "item_id").agg(F.count(F.lit(1)).alias("actions"))
    df = telemetry.join(logged, ["run_id", "item_id"], "full")
    actions_ = F.coalesce("actions", F.lit(0))
    rule = first_match(
        [
            (F.col("mode").isNull(), "ACTION_WITHOUT_TELEMETRY"),
            ((F.col("mode") != "ENFORCE") & (actions_ > 0), "REPORT_MODE_LOGGED_ACTION"),
            ((F.col("mode") == "ENFORCE") & F.col("attempted") & (actions_ != 1), "ATTEMPT_WITHOUT_ONE_ACTION"),
            ((F.col("mode") == "ENFORCE") & ~F.col("attempted") & (actions_ > 0), "ACTION_WITHOUT_ATTEMPT"),
        ]
    )
    return df.select("run_id", "item_id", rule.alias("violation"), actions_.alias("actions")).where("violation IS NOT NULL")
