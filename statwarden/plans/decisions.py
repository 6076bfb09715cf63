"""Queries over the statistic fleet: thresholds, ratios, decisions, commands."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c
from statwarden.functions.temporal import minute_boundaries
from statwarden.operators import command, decision, overrides, thresholds, workflow
from statwarden.plans.fixtures import AS_OF
from statwarden.plans.oracle_parts import DECIDED, DECIDED_FRAMES, NATIVE, WINNER
from statwarden.plans.registry import Inputs, query

AS_OF_TIME = datetime.fromisoformat(AS_OF)
MAXDOP = 4


def with_age(facts: DataFrame) -> DataFrame:
    now = F.lit(AS_OF_TIME).cast("timestamp_ntz")
    return facts.withColumn("stats_age_minutes", minute_boundaries(F.col("last_updated"), now))


def native(x: Inputs, facts: DataFrame | None = None) -> DataFrame:
    return with_age(thresholds.with_native_threshold(x.spread("fleet") if facts is None else facts))


def joined(
    x: Inputs, facts: DataFrame | None = None, modes: tuple[str, ...] | None = None, more: Callable[[DataFrame], DataFrame] = lambda facts: facts
) -> DataFrame:
    """Facts with winning override and native thresholds, once per policy (three constant rows) of the given modes.

    ``more`` adds to the facts before that; thresholds come last, as their texts are half of a row that need not be shuffled.
    """
    policies = x.policies if modes is None else x.policies.where(F.col("mode").isin(*modes))
    facts = x.spread("fleet") if facts is None else facts
    # facts of few splits are dealt over all cores anyway, so holding them against marks first would save nothing
    read_twice = x.spread("fleet") is x.fleet
    with_override = overrides.with_winning_override(facts, x.overrides, AS_OF_TIME, sizes=x.fleet, read_twice=read_twice)
    return native(x, more(with_override)).crossJoin(F.broadcast(decision.complete_policy(policies)))


def decided(x: Inputs) -> DataFrame:
    return decision.decide(joined(x))


def fleet_query(key: str, columns: str):
    """A query over the facts with native thresholds only."""
    cols = ["stats_id", *columns.split()]

    @query(key, f"SELECT {', '.join(cols)} FROM native", ("fleet",), (NATIVE,))
    def run(x: Inputs) -> DataFrame:
        return native(x).select(*cols)


def decision_query(key: str, columns: str):
    """A query over all decisions."""
    cols = ["policy_id", "stats_id", *columns.split()]

    @query(key, f"SELECT {', '.join(cols)} FROM decided", DECIDED_FRAMES, DECIDED)
    def run(x: Inputs) -> DataFrame:
        return decided(x).select(*cols)


fleet_query("thr_native", "native_basis native_threshold")
fleet_query("thr_native_policy", "native_policy native_formula")
fleet_query("thr_native_progress", "native_remaining native_progress_percent native_reached native_is_estimate native_applicable")
fleet_query("thr_native_state", "native_state")
fleet_query("row_count_delta", "current_rows row_count_delta")
decision_query("thr_governance", "governance_basis_rows governance_threshold")
decision_query("thr_governance_progress", "governance_remaining governance_progress_percent governance_reached")
decision_query("thr_compare", "governance_native_delta governance_native_comparison")
decision_query("ratio_modification", "mod_ratio_percent")
decision_query("ratio_sample", "actual_sample_percent")
decision_query("warn_low_sample", "low_sample_warning low_sample_limit_percent")
decision_query("dec_skew_class", "skew_class histogram_dominant_percent histogram_top3_percent")
decision_query("dec_persist", "persist_option is_eligible reason")
decision_query("dec_capability_gate", "can_execute capability_reason")
decision_query("dec_persistence_advisory", "persistence_advisory")
decision_query("dec_method", "collection_method requested_sample_percent requested_sample_rows sampling_source fullscan_eligible fullscan_reason")
decision_query("decide_fleet", " ".join(decision.DECISION_COLUMNS) + " o_override_id")


@query("dec_eligibility", "SELECT policy_id, stats_id, ladder_reason, e0 AS ladder_eligible FROM decided", DECIDED_FRAMES, DECIDED)
def dec_eligibility(x: Inputs) -> DataFrame:
    """The ladder alone, before sampling conflicts revoke anything."""
    ladder = decision.with_ladder(joined(x))
    return ladder.select("policy_id", "stats_id", "ladder_reason", "ladder_eligible")


@query(
    "dec_sample_rows_override",
    """SELECT policy_id, stats_id, o_sample_rows, o_persistence_mode, persisted_percent, revoke1 AS row_conflict,
       is_eligible, reason, requested_sample_rows, sampling_source, persist_option
       FROM decided WHERE o_action = 'FORCE_SAMPLE_ROWS' AND e0""",
    DECIDED_FRAMES,
    DECIDED,
)
def dec_sample_rows_override(x: Inputs) -> DataFrame:
    df = decision.with_gate(decision.with_persistence(decision.with_method(decision.with_ladder(joined(x)))))
    return df.where((F.col("o_action") == "FORCE_SAMPLE_ROWS") & F.col("ladder_eligible")).select(
        "policy_id", "stats_id", "o_sample_rows", "o_persistence_mode", "persisted_percent", "row_conflict",
        "is_eligible", "reason", "requested_sample_rows", "sampling_source", "persist_option",
    )


@query(
    "win_top1_override",
    """SELECT f.stats_id, w.override_id AS o_override_id, w.o_action, w.o_force_update, w.o_persistence_mode
       FROM fleet f LEFT JOIN winner w USING (stats_id)""",
    ("fleet", "overrides"),
    (WINNER,),
)
def win_top1_override(x: Inputs) -> DataFrame:
    df = overrides.with_winning_override(x.fleet, x.overrides, AS_OF_TIME)
    return df.select("stats_id", "o_override_id", "o_action", "o_force_update", "o_persistence_mode")


@query(
    "src_overrides",
    f"""SELECT override_id, database_name, schema_name, table_name, stat_name, action, sample_rows, expires_at
        FROM overrides WHERE is_enabled AND coalesce(expires_at > TIMESTAMP '{AS_OF}', true)""",
    ("overrides",),
)
def src_overrides(x: Inputs) -> DataFrame:
    return overrides.active(x.overrides, AS_OF_TIME).select(
        "override_id", "database_name", "schema_name", "table_name", "stat_name", "action", "sample_rows", "expires_at"
    )


@query(
    "status_initial",
    """SELECT policy_id, stats_id, CASE WHEN mode = 'OBSERVE' THEN 'OBSERVED' WHEN NOT is_eligible THEN 'DEFERRED'
         WHEN NOT can_execute THEN 'BLOCKED_CAPABILITY' WHEN mode = 'RECOMMEND' THEN 'RECOMMENDED' ELSE 'PENDING' END AS execution_status
       FROM decided""",
    DECIDED_FRAMES,
    DECIDED,
)
def status_initial(x: Inputs) -> DataFrame:
    df = decided(x)
    return df.select(
        "policy_id", "stats_id", workflow.initial_status(c.mode, c.is_eligible, c.can_execute).alias("execution_status")
    )


COMMAND_SQL = """CASE WHEN can_execute THEN 'USE [' || database_name || ']; UPDATE STATISTICS [' || schema_name || '].[' || table_name
         || '] ([' || stat_name || ']) WITH '
         || CASE collection_method WHEN 'FULLSCAN' THEN 'FULLSCAN, '
              WHEN 'SAMPLE_PERCENT' THEN 'SAMPLE ' || CAST(requested_sample_percent AS VARCHAR) || ' PERCENT, '
              WHEN 'SAMPLE_ROWS' THEN 'SAMPLE ' || CAST(requested_sample_rows AS VARCHAR) || ' ROWS, ' ELSE '' END
         || CASE WHEN persist_option THEN 'PERSIST_SAMPLE_PERCENT = ON, ' WHEN NOT persist_option THEN 'PERSIST_SAMPLE_PERCENT = OFF, ' ELSE '' END
         || 'MAXDOP = 4' || CASE WHEN no_recompute THEN ', NORECOMPUTE' ELSE '' END || ';' END"""


@query(
    "cmd_build",
    f"SELECT policy_id, stats_id, {COMMAND_SQL} AS command FROM decided",
    DECIDED_FRAMES,
    DECIDED,
)
def cmd_build(x: Inputs) -> DataFrame:
    df = decided(x)
    return df.select("policy_id", "stats_id", command.refresh_command(c, F.lit(MAXDOP)).alias("command"))
