"""The states of planned work as a fold over its events, transitions checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.operators.telemetry import STAT_ID

EVENT = "seq int, state string, reason string, error_number int, at timestamp_ntz"
NONE = "NONE"
# fixed values: the states that may follow a state; statuses of the post-check follow a success
SKIPS = ("SKIPPED_DATABASE_EXCLUDED", "SKIPPED_SCOPE_BLOCKED")
POSTCHECKS = (
    "METADATA_COLLECTED", "STATISTIC_NOT_FOUND", "NO_STATISTICS_BLOB", "PERSISTENCE_VALIDATION_FAILED", "SKIPPED_SCOPE_CHANGE", "COLLECTION_FAILED",
)
NEXT = {
    NONE: ("OBSERVED", "DEFERRED", "BLOCKED_CAPABILITY", "RECOMMENDED", "PENDING"),
    "PENDING": (
        *SKIPS, "SKIPPED_REVALIDATION_ERROR", "SKIPPED_REVALIDATED", "BLOCKED_CAPABILITY", "EXECUTING", "NOT_STARTED_WINDOW",
        "SKIPPED_COLLECTION_ERROR", "SKIPPED_RUN_ABORTED",
    ),
    "BLOCKED_CAPABILITY": SKIPS,
    "EXECUTING": ("SUCCEEDED", "FAILED"),
    "SUCCEEDED": POSTCHECKS,
}


def _is_legal(before: Column, after: Column) -> Column:
    return F.concat_ws(">", before, after).isin([f"{a}>{b}" for a, following in NEXT.items() for b in following])


def folded(events: DataFrame) -> DataFrame:
    """One row per statistic and run: status, post-check, attempt, times, and what broke the order of states.

    An event that may not follow the state before it is not taken; the first such one is
    the violation. An event written twice counts once. An item has few events, so its
    list is short whatever the size of the run.
    """
    names = [part.split(" ")[0] for part in EVENT.split(", ")]
    listed = events.groupBy(*STAT_ID).agg(F.sort_array(F.collect_set(F.struct(*names))).alias("events"))
    start = F.struct(
        F.lit(NONE).alias("last"), F.lit(NONE).alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("error_number"),
        F.lit(None).cast("string").alias("postcheck"), F.lit(None).cast("string").alias("violation"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("ended_at"),
    )

    def step(acc: Column, e: Column) -> Column:
        legal = _is_legal(acc["last"], e["state"])
        post = e["state"].isin(*POSTCHECKS)
        broken = F.concat_ws(">", acc["last"], e["state"])

        def taken(value: Column, name: str, on: Column | None = None) -> Column:
            return F.when(legal if on is None else legal & on, value).otherwise(acc[name]).alias(name)

        return F.struct(
            taken(e["state"], "last"), taken(e["state"], "status", ~post), taken(e["reason"], "reason", ~post & e["reason"].isNotNull()),
            taken(e["error_number"], "error_number", ~post), taken(e["state"], "postcheck", post),
            F.coalesce(acc["violation"], F.when(~legal, broken)).alias("violation"),
            taken(e["at"], "started_at", e["state"] == "EXECUTING"), taken(e["at"], "ended_at", e["state"].isin("SUCCEEDED", "FAILED")),
        )

    state = F.aggregate("events", start, step)
    return listed.select(*STAT_ID, state.alias("s")).select(
        *STAT_ID, F.col("s.status").alias("execution_status"), F.col("s.reason").alias("execution_reason"), "s.error_number",
        F.col("s.postcheck").alias("postcheck_status"), F.col("s.started_at").isNotNull().alias("attempted"), "s.started_at", "s.ended_at", "s.violation",
    )


def violations(events: DataFrame) -> DataFrame:
    """Statistics whose events break the order of states, or that were left while executing."""
    left = F.when(F.col("execution_status") == "EXECUTING", F.lit("EXECUTING>"))
    return folded(events).select(*STAT_ID, F.coalesce("violation", left).alias("violation")).where("violation IS NOT NULL")
