"""A governance run: choose databases, decide for every statistic, plan the work.

``govern`` checks its parameters, then builds lazy frames; the only early actions
are existence checks that stop a run before it starts. ``second_look`` and
``finish`` carry an enforcing run through re-validation, execution and post-check.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.functions.logic import c, holds
from statwarden.functions.temporal import minute_boundaries
from statwarden.functions.text import has_empty_token, list_tokens, name_part
from statwarden.operators import catalog, decision, overrides, scope, selection, skew, telemetry, thresholds, workflow
from statwarden.operators.checks import SETTINGS_VERSION

MODES = ("OBSERVE", "RECOMMEND", "ENFORCE")  # fixed values
TIERS = ("LOW", "STANDARD", "HIGH")
MAX_WINDOW_MINUTES = 525_600


class GovernanceError(ValueError):
    """A run that must not start; ``code`` is the rule it breaks."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class GovernanceRequest:
    """Parameters of a run. Zero minutes means no time limit."""

    databases: str
    mode: str = "RECOMMEND"
    maxdop: int = 4
    row_floor: int = 1_000_000
    low_sample_percent: Decimal = Decimal("2.0")
    large_table_rows: int = 20_000_000
    default_percent: Decimal | None = None
    max_minutes: int = 300
    io_tier: str = "STANDARD"
    legacy_multiplier: Decimal = Decimal("2.0")
    statistics_scope: str = "ALL"

    def checked(self) -> GovernanceRequest:
        """The request with texts trimmed and upper-cased; raises on a bad value."""
        r = replace(
            self,
            databases=(self.databases or "").strip(),
            mode=(self.mode or "").strip().upper(),
            io_tier=(self.io_tier or "").strip().upper(),
            statistics_scope=(self.statistics_scope or "").strip().upper(),
        )

        def within(value, low, high):
            return value is not None and low <= value <= high

        rules = [
            (51024, "mode must be OBSERVE, RECOMMEND or ENFORCE", r.mode in MODES),
            (51025, "name databases or a database group", bool(r.databases)),
            (51120, "unknown statistics scope", r.statistics_scope in catalog.SCOPES),
            (51026, "maxdop must be 1 to 64", within(r.maxdop, 1, 64)),
            (
                51027,
                "invalid row floor or large-table limit",
                within(r.row_floor, 0, 2**63) and r.large_table_rows is not None and r.large_table_rows >= max(r.row_floor, 1),
            ),
            (
                51028,
                "invalid percentage or multiplier",
                within(r.low_sample_percent, 0, 100)
                and (r.default_percent is None or 0 < r.default_percent <= 100)
                and within(r.legacy_multiplier, 1, 100),
            ),
            (51029, "minutes must be 0 to 525600", within(r.max_minutes, 0, MAX_WINDOW_MINUTES)),
            (51030, "io tier must be LOW, STANDARD or HIGH", r.io_tier in TIERS),
        ]
        for code, message, valid in rules:
            if not valid:
                raise GovernanceError(code, message)
        return r


@dataclass(frozen=True)
class Fleet:
    """Input frames: catalog, control tables and statistic facts."""

    datasets: DataFrame
    scope: DataFrame
    settings: DataFrame
    facts: DataFrame
    overrides: DataFrame
    utility_name: str = "GovernanceDb"
    tables: DataFrame | None = None  # all tables (database_id, database_name, schema_name, table_name), with or without statistics


@dataclass(frozen=True)
class RunPlan:
    """What a run decided; all frames are lazy."""

    request: GovernanceRequest
    run_id: str
    as_of: datetime
    policy: DataFrame
    runs: DataFrame
    run_databases: DataFrame
    facts: DataFrame
    telemetry: DataFrame


def _stop_if(found: DataFrame, code: int, message: str) -> None:
    """Stops with the first of the rows found, in the order of their columns."""
    first = found.orderBy(*found.columns).head(1)
    if first:
        raise GovernanceError(code, f"{message}: {first[0]}")


def select_databases(spark: SparkSession, databases: str, fleet: Fleet) -> DataFrame:
    """Databases of a group selector or explicit list, with scope and selection status."""
    d = fleet.datasets
    if databases.upper() in selection.GROUPS:
        chosen = selection.select_group(d, databases, fleet.utility_name)
    else:
        request = spark.createDataFrame([(0, databases)], "request_id int, listed string")
        resolved = selection.resolve_lists(request, d)
        _stop_if(resolved.where("violation IS NOT NULL").select("violation"), 51031, "database list rejected")
        chosen = d.join(resolved.select("database_id"), "database_id", "left_semi")
    if chosen.isEmpty():
        raise GovernanceError(51032, "no database matches the selection")
    return selection.with_selection_status(scope.effective_scope(chosen, fleet.scope))


def resolve_targets(spark: SparkSession, tables: str, known: DataFrame) -> DataFrame:
    """Two-part table names in catalog spelling; every name must be among the ``known`` tables."""
    request = spark.createDataFrame([(tables,)], "listed string")
    _stop_if(request.where(has_empty_token(F.col("listed"))), 51133, "empty item in table list")
    tokens = request.select(F.explode(list_tokens(F.col("listed"))).alias("token"))
    parts = {n: name_part(F.col("token"), n) for n in (1, 2, 3, 4)}
    too_many = F.size(F.split("token", r"\.(?![^\[]*\])", -1)) != 2
    _stop_if(tokens.where(parts[1].isNull() | parts[2].isNull() | too_many), 51134, "not a two-part name")
    wanted = tokens.select(parts[2].alias("schema_name"), parts[1].alias("table_name")).distinct()
    known = known.select("database_name", "schema_name", "table_name").distinct()
    _stop_if(catalog.missing_targets(wanted, known), 51136, "table not found")
    return catalog.canonical_targets(wanted, known)


def effective_policy(request: GovernanceRequest, settings: DataFrame) -> DataFrame:
    """The single settings row with the parameters of the request."""
    row = settings.where((c.settings_id == 1) & (c.schema_version == SETTINGS_VERSION))
    found = len(row.take(2))
    if found != 1:
        raise GovernanceError(51037, "missing or incompatible settings" if not found else "several settings rows")
    named = row.select(
        "update_threshold_percent",
        c.min_modification_count.alias("min_modifications"),
        c.min_update_interval_minutes.alias("cooldown_minutes"),
        c.skew_sampling_enabled.alias("skew_enabled"),
        "moderate_skew_percent", "high_skew_percent", "extreme_skew_percent",
        c.high_skew_sample_rows.alias("high_skew_rows"), c.extreme_skew_sample_rows.alias("extreme_skew_rows"),
        F.lit(request.row_floor).cast("bigint").alias("row_floor"),
        F.lit(request.large_table_rows).cast("bigint").alias("large_table_rows"),
        F.lit(request.default_percent).cast("decimal(9,4)").alias("default_percent"),
        F.lit(request.low_sample_percent).cast("decimal(9,4)").alias("low_sample_percent"),
        F.lit(request.legacy_multiplier).cast("decimal(9,4)").alias("legacy_multiplier"),
    )
    return decision.complete_policy(named)


def decided_facts(facts: DataFrame, approved: DataFrame, policy: DataFrame, as_of: datetime, sizes: DataFrame | None = None) -> DataFrame:
    """Facts with threshold, age, winning override, policy (one row) and decision."""
    now = F.lit(as_of).cast("timestamp_ntz")
    aged = thresholds.with_native_threshold(facts).withColumn("stats_age_minutes", minute_boundaries(c.last_updated, now))
    return decision.decide(overrides.with_winning_override(aged, approved, as_of, sizes=sizes).crossJoin(F.broadcast(policy)))


def govern(request: GovernanceRequest, fleet: Fleet, run_id: str, as_of: datetime, targets: DataFrame | None = None) -> RunPlan:
    """Plans a run. ``as_of`` and ``run_id`` are given, so a run can be repeated exactly."""
    request = request.checked()
    spark = fleet.facts.sparkSession
    chosen = select_databases(spark, request.databases, fleet)
    included = chosen.where(~holds(c.is_excluded))
    _stop_if(included.where("NOT ready_for_collection").select("database_name"), 51033, "database not ready")
    if request.mode == "ENFORCE":
        _stop_if(included.where(~holds(c.enabled)).select("database_name"), 51036, "database not approved for enforcement")
    if targets is not None:
        names = [r.database_name for r in included.select("database_name").take(2)]
        if len(names) != 1:
            raise GovernanceError(51122, "targets need exactly one resolved database")
        _stop_if(targets.where(c.database_name != names[0]).select("database_name"), 51123, "a target is in another database")
    policy = effective_policy(request, fleet.settings)
    facts = fleet.facts.where(catalog.visible(c) & catalog.in_statistics_scope(c, request.statistics_scope))
    in_scope = facts
    facts = catalog.keep_targets(skew.keep(facts, included, ["database_id"], ["stats_id"]), targets, sizes=in_scope)
    decided = decided_facts(facts, fleet.overrides, policy, as_of, sizes=in_scope).withColumns(
        {"run_id": F.lit(run_id), "mode": F.lit(request.mode)}
    )
    deadline = as_of + timedelta(minutes=request.max_minutes) if request.max_minutes else None
    runs = policy.select(
        F.lit(run_id).alias("run_id"), F.lit(request.mode).alias("mode"), F.lit(as_of).cast("timestamp_ntz").alias("started_at"),
        F.lit(deadline).cast("timestamp_ntz").alias("deadline_at"), F.lit(request.maxdop).alias("requested_maxdop"),
        F.lit(request.statistics_scope).alias("statistics_scope"), F.lit(targets is not None).alias("is_targeted_run"),
        F.to_json(F.struct("*")).alias("parameters"),
    )
    run_databases = chosen.withColumns(
        {
            "run_id": F.lit(run_id),
            "mode": F.lit(request.mode),
            "collection_status": F.when(holds(c.is_excluded), "SKIPPED_EXCLUDED").otherwise("PENDING"),
            # until a gate is checked
            "last_scope_status": F.when(holds(c.is_excluded), "EXCLUDED").otherwise("ALLOWED"),
        }
    )
    return RunPlan(request, run_id, as_of, policy, runs, run_databases, in_scope, telemetry.initial(decided, F.lit(request.maxdop)))


def govern_targeted(
    databases: str,
    tables: str | None,
    fleet: Fleet,
    run_id: str,
    as_of: datetime,
    **parameters,
) -> RunPlan:
    """A run over named tables (``schema.table, ...``) of exactly one database."""
    request = GovernanceRequest(databases, **parameters).checked()
    tables = (tables or "").strip()
    if not tables:
        return govern(request, fleet, run_id, as_of)
    if request.databases.upper() in selection.GROUPS:
        raise GovernanceError(51130, "name one database when tables are given")
    spark = fleet.facts.sparkSession
    rows = select_databases(spark, request.databases, fleet).select("database_id", "ready_for_collection").take(2)
    if len(rows) != 1:
        raise GovernanceError(51131, "name one database when tables are given")
    if not rows[0].ready_for_collection:
        raise GovernanceError(51132, "the database is not ready")
    known = fleet.facts.where(catalog.visible(c)) if fleet.tables is None else fleet.tables
    return govern(request, fleet, run_id, as_of, resolve_targets(spark, tables, known.where(c.database_id == rows[0].database_id)))


def second_look(plan: RunPlan, gates: DataFrame, fresh: DataFrame, approved: DataFrame) -> DataFrame:
    """Telemetry after the database gate and a second decision over fresh facts.

    ``fresh`` holds facts read again, with ``fresh_`` identity columns.
    """
    again = decided_facts(fresh, approved, plan.policy, plan.as_of).withColumn("run_id", F.lit(plan.run_id))
    sizes = plan.facts.select("database_id", F.lit(plan.run_id).alias("run_id"))
    return telemetry.revalidated(telemetry.gated(plan.telemetry, gates, sizes=sizes), again)


def within_window(plan: RunPlan, looked: DataFrame, costs: DataFrame) -> DataFrame:
    """Telemetry with the work left out that the time limit of the request does not reach; zero minutes is no limit."""
    minutes = plan.request.max_minutes
    return telemetry.cut_off(looked, costs, minutes * 60 if minutes else None)


def finish(looked: DataFrame, outcomes: DataFrame, after: DataFrame) -> DataFrame:
    """Telemetry after execution (``telemetry.STAT_ID``, action_error) and post-check."""
    df = looked.join(outcomes.select(*telemetry.STAT_ID, "action_error"), telemetry.STAT_ID, "left")
    ran = telemetry.executed(df, c.action_error, c.action_error.isNotNull()).drop("action_error")
    return telemetry.postchecked(ran, after)


def summarize(final: DataFrame, run_databases: DataFrame) -> DataFrame:
    """Counters and status of each run."""
    return workflow.run_summary(final, run_databases)
