"""An enforcing run over a lake in one call: plan, gate, second look, refresh, log, post-check.

The run keeps its state in a folder of its own. Work is done in units of a few tables;
each phase of a unit writes its events to a folder that only it writes, results first,
events after. So a run that was stopped at any point is called again with the same
run_id and goes on: what has results is not refreshed a second time, what has none is
done anew, and writing a phase again replaces it. The log is append-only across phases.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c
from statwarden.govern import Fleet, GovernanceError, GovernanceRequest, RunPlan, decided_facts, govern
from statwarden.operators import collect, profile, scope, selection, states, telemetry, workflow
from statwarden.sources import store

ERROR_REFRESH = 50000  # of a refresh that ended with an exception
PLANNED, GATED, LOOKED, STARTED, ENDED, CHECKED = range(6)


@dataclass(frozen=True)
class Lake:
    """Tables of one database that a run may refresh, and what is known about them."""

    tables: Mapping[str, DataFrame]
    row_keys: Mapping[str, Sequence[str]]
    states: collect.ColumnStates
    refreshes: collect.RefreshLog
    catalog: DataFrame
    environment: DataFrame

    def facts(self) -> DataFrame:
        return collect.facts(self.catalog, self.states, self.refreshes, self.environment)


@dataclass(frozen=True)
class Run:
    """A finished or stopped run: final telemetry, events, databases and the run's row."""

    telemetry: DataFrame
    events: DataFrame
    databases: DataFrame
    summary: DataFrame


class RunFolder:
    """The tables of a run; ``put`` replaces a part as a whole."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def has(self, part: str) -> bool:
        return store.is_complete(self.spark, f"{self.folder}/{part}")

    def get(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}")

    def put(self, df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{part}")
        return self.get(part)

    def log(self, rows: DataFrame, unit: int, phase: int, state, at: datetime, reason=None, error=None) -> None:
        """Events of a unit's phase; ``state``, ``reason`` and ``error`` are columns of ``rows``."""
        event = rows.select(
            *telemetry.STAT_ID, F.lit(phase).alias("seq"), state.alias("state"),
            (F.lit(None) if reason is None else reason).cast("string").alias("reason"),
            (F.lit(None) if error is None else error).cast("int").alias("error_number"), F.lit(at).cast("timestamp_ntz").alias("at"),
        )
        event.write.mode("overwrite").parquet(f"{self.folder}/events/unit={unit}/phase={phase}")

    def logged(self, unit: int, phase: int) -> bool:
        return self.has(f"events/unit={unit}/phase={phase}")

    def events(self) -> DataFrame:
        return self.get("events").drop("unit", "phase")


def start(request: GovernanceRequest, fleet: Fleet, lake: Lake, run_id: str, as_of: datetime, run: RunFolder) -> tuple[DataFrame, RunPlan]:
    """The run's plan, written once; a run that goes on reads it."""
    if request.checked().mode != "ENFORCE":
        raise GovernanceError(51024, "this call enforces; use govern to report")
    if not run.has("planned"):
        # what the run decides on is kept, and long plans start from a table
        plan = govern(request, replace(fleet, facts=run.put(lake.facts(), "facts")), run_id, as_of)
        rows = run.put(plan.telemetry, "telemetry")
        run.put(plan.run_databases, "databases")
        run.put(plan.runs, "runs")
        run.log(rows, 0, PLANNED, c.execution_status, as_of, c.execution_reason)
        run.put(plan.policy, "planned")
    rows = run.get("telemetry")
    plan = RunPlan(request.checked(), run_id, as_of, run.get("planned"), run.get("runs"), run.get("databases"), rows, rows)
    return rows, plan


def units(rows: DataFrame, tables_per_unit: int) -> list[list[str]]:
    """Tables with open work in key order, a few at a time; the driver holds names of tables only."""
    open_ = rows.where(c.execution_status.isin("PENDING", "BLOCKED_CAPABILITY"))
    named = open_.select("database_id", "object_id", "table_name").distinct().orderBy("database_id", "object_id")
    names = [r.table_name for r in named.toLocalIterator()]
    return [names[i : i + tables_per_unit] for i in range(0, len(names), tables_per_unit)]


def late_tables(rows: DataFrame, lake: Lake, request: GovernanceRequest, run_id: str) -> DataFrame | None:
    """Tables that the time limit is not expected to reach: scans start in key order until the expected costs before them use it up."""
    if not request.max_minutes:
        return None
    costs = collect.table_costs(lake.catalog, lake.refreshes.entries(), lake.states.totals())
    pending = rows.where(c.execution_status == "PENDING").select("database_id", "object_id", "table_name").distinct()
    items = pending.join(costs, ["database_id", "object_id"], "left").select(
        F.lit(run_id).alias("run_id"), "database_id", "object_id", "table_name", F.coalesce("cost_seconds", F.lit(0)).cast("bigint").alias("cost_seconds"),
        F.lit(request.max_minutes * 60).alias("budget_seconds"),
    )
    return workflow.window_cutoff(items, order=("database_id", "object_id")).where("execution_status <> 'PENDING'").select("table_name")


def gates(plan: RunPlan, now: Fleet) -> DataFrame:
    chosen = plan.run_databases.select("run_id", "database_id", "database_name", "created_at", "selection_status", "mode")
    return selection.with_gate(chosen, now.datasets, scope.effective_scope(now.datasets, now.scope))


def fresh_facts(lake: Lake, tables: Sequence[str]) -> DataFrame:
    again = lake.facts().where(c.table_name.isin(list(tables)))
    same = {f"fresh_{n}": F.col(n) for n in ("database_id", "schema_name", "table_name", "stat_name", "created_at")}
    return again.withColumns({**same, "fresh_found": F.lit(True)})


def enforce(
    request: GovernanceRequest,
    fleet: Fleet,
    lake: Lake,
    run_id: str,
    as_of: datetime,
    folder: str,
    clock: Callable[[], datetime],
    present: Callable[[], Fleet] | None = None,
    tables_per_unit: int = profile.TABLES_PER_JOB,
) -> Run:
    """Runs, or goes on with, the enforcing run ``run_id`` in ``folder``.

    ``clock`` tells the time for deadline and log; ``present`` reads catalog and scope
    again for the gates (the given fleet by default). A refresh that fails is logged
    and the run goes on; any other error marks open work SKIPPED_RUN_ABORTED and is raised.
    """
    run = RunFolder(lake.catalog.sparkSession, f"{folder}/{run_id}")
    rows, plan = start(request, fleet, lake, run_id, as_of, run)
    present = present or (lambda: fleet)
    deadline = as_of + timedelta(minutes=request.max_minutes) if request.max_minutes else None
    if not run.has("work"):
        names = [(n, t) for n, listed in enumerate(units(rows, tables_per_unit), 1) for t in listed]
        late = late_tables(rows, lake, plan.request, run_id)
        work = run.spark.createDataFrame(names, "unit int, table_name string")
        late = None if late is None else late.withColumn("late", F.lit(True))
        run.put(work.withColumn("late", F.lit(False)) if late is None else work.join(late, "table_name", "left").withColumn("late", F.coalesce("late", F.lit(False))), "work")
    listed: dict[int, list[str]] = {}
    for r in run.get("work").where("NOT late").orderBy("unit", "table_name").toLocalIterator():
        listed.setdefault(r.unit, []).append(r.table_name)
    try:
        late = run.get("work").where("late").select("table_name")
        outside = rows.where(c.execution_status == "PENDING").join(late, "table_name", "left_semi")
        if not run.logged(0, GATED):
            run.log(outside, 0, GATED, F.lit("NOT_STARTED_WINDOW"), as_of, F.lit("MAINTENANCE_DEADLINE"))
        for unit, names in listed.items():
            if run.logged(unit, CHECKED):
                continue
            if deadline is not None and clock() >= deadline and not run.has(f"results/unit={unit}"):
                rest = [t for u, some in listed.items() if u >= unit for t in some]
                left = rows.where((c.execution_status == "PENDING") & c.table_name.isin(rest))
                run.log(left, unit, GATED, F.lit("NOT_STARTED_WINDOW"), clock(), F.lit("MAINTENANCE_DEADLINE"))
                break
            work_unit(run, plan, rows.where(c.table_name.isin(names)), names, unit, lake, fleet, present, clock)
    except Exception:
        aborted = states.folded(run.events()).where("execution_status = 'PENDING'")
        run.log(aborted, len(listed) + 1, GATED, F.lit("SKIPPED_RUN_ABORTED"), clock(), F.lit("RUN_ABORTED"))
        raise
    return result(run, plan)


def work_unit(run: RunFolder, plan: RunPlan, rows: DataFrame, names: list[str], unit: int, lake: Lake, fleet: Fleet, present, clock) -> None:
    """All phases of a unit that are not logged yet."""
    if not run.logged(unit, STARTED):
        closed = telemetry.gated(rows, gates(plan, present()))
        run.log(closed.where(c.execution_status.isin(*states.SKIPS)), unit, GATED, c.execution_status, clock(), c.execution_reason, c.error_number)
        again = decided_facts(run.put(fresh_facts(lake, names), f"fresh/unit={unit}"), fleet.overrides, plan.policy, plan.as_of).withColumn("run_id", F.lit(plan.run_id))
        pending = closed.where("execution_status = 'PENDING'")
        looked = run.put(telemetry.revalidated(pending, again), f"looked/unit={unit}")
        stopped = looked.where("execution_status <> 'PENDING'")
        run.log(stopped, unit, LOOKED, c.execution_status, clock(), c.execution_reason, c.error_number)
        run.log(looked.where("execution_status = 'PENDING'"), unit, STARTED, F.lit("EXECUTING"), clock())
    looked = run.get(f"looked/unit={unit}")
    started = looked.where("execution_status = 'PENDING'")
    if not run.logged(unit, ENDED):
        refresh(run, plan, looked, unit, lake, clock)
    # a success that was logged is post-checked; it never leads to a second refresh
    done = started.join(_ended(run, unit).where("state = 'SUCCEEDED'"), telemetry.STAT_ID, "left_semi")
    try:
        verdicts = gates(plan, present()).select("run_id", "database_id", "gate_reason", "can_process")
        after = lake.facts().select(
            F.lit(plan.run_id).alias("run_id"), *telemetry.STAT_ID[1:], F.lit(True).alias("after_found"), F.col("current_rows").alias("after_rows"),
            F.col("rows_sampled").alias("after_rows_sampled"), F.col("persisted_percent").alias("after_persisted"), F.col("last_updated").alias("after_last_updated"),
        )
        checked = telemetry.postchecked(done.withColumn("execution_status", F.lit("SUCCEEDED")), after).join(verdicts, ["run_id", "database_id"], "left")
        status = F.when(c.can_process, c.postcheck_status).otherwise(F.lit("SKIPPED_SCOPE_CHANGE"))
        run.log(checked, unit, CHECKED, status, clock(), F.when(~c.can_process, c.gate_reason))
    except GovernanceError:
        raise
    except Exception as error:  # a failed post-check must not run a successful refresh again
        run.log(done, unit, CHECKED, F.lit("COLLECTION_FAILED"), clock(), F.lit(type(error).__name__))


def _ended(run: RunFolder, unit: int) -> DataFrame:
    return run.get(f"events/unit={unit}/phase={ENDED}")


def refresh(run: RunFolder, plan: RunPlan, looked: DataFrame, unit: int, lake: Lake, clock) -> None:
    """Profiles the started columns, one scan per table, unless the unit's results are there already; then logs how it ended."""
    started = looked.where("execution_status = 'PENDING'")
    part = f"results/unit={unit}"
    if not run.has(part):
        begun = clock()
        try:
            wanted = started.select(
                *telemetry.STAT_ID, "table_name", "column_name", c.re_method.alias("collection_method"), c.re_percent.alias("requested_sample_percent"),
                c.re_rows.alias("requested_sample_rows"), "current_rows",
                F.when(c.re_persist, c.re_percent).when(~c.re_persist, 0).otherwise(c.persisted_percent).cast("decimal(19,6)").alias("persisted_percent"),
            )
            # totals of the version that is read: rows moved meanwhile count for the next run
            totals = lake.states.totals(lake.states.version())
            work = f"work-{unit}-{uuid.uuid4().hex}"
            # the entries are joined to what they are made of: written, so that the histograms are made once
            found = run.put(profile.refresh_batch(wanted, lake.tables, lake.row_keys, f"{run.folder}/{work}"), f"{work}/found")
            entries = collect.refreshed(found, totals, begun, 0.0)
            results = run.put(found.select(*telemetry.STAT_ID, "table_name", "column_name", "after_steps", "sampled_values").join(entries, ["table_name", "column_name"]), f"profiled/unit={unit}")
            run.put(results.withColumn("elapsed_seconds", F.lit((clock() - begun).total_seconds())), part)
        except Exception as error:  # of this unit; the others go on
            run.log(started, unit, ENDED, F.lit("FAILED"), clock(), F.lit(type(error).__name__), F.lit(ERROR_REFRESH))
            return
    results = run.get(part)
    lake.refreshes.record(results, plan.run_id, unit)
    run.log(results, unit, ENDED, F.lit("SUCCEEDED"), clock(), error=F.lit(0))


def result(run: RunFolder, plan: RunPlan) -> Run:
    """Final telemetry of what the events say, and the run's counters and status."""
    events = run.events()
    final = run.get("telemetry").drop("execution_status", "execution_reason", "error_number").join(states.folded(events), telemetry.STAT_ID, "left")
    checked = gates_of(plan, final)
    return Run(final, events, checked, workflow.run_summary(final, checked))


def gates_of(plan: RunPlan, final: DataFrame) -> DataFrame:
    """The run's databases with what became of them: how much was late, failed or stopped by scope."""
    per = final.groupBy("run_id", "database_id").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(c.execution_status == "NOT_STARTED_WINDOW").alias("late"),
        F.count_if(c.attempted).alias("attempted"),
        F.max(F.when(c.execution_status.isin(*states.SKIPS), c.execution_status)).alias("skipped"),
    )
    df = plan.run_databases.drop("collection_status", "last_scope_status").join(per, ["run_id", "database_id"], "left")
    excluded = F.coalesce(c.is_excluded, F.lit(False))
    collected = c.candidate_count.isNotNull()
    return df.select(
        *plan.run_databases.drop("collection_status", "last_scope_status").columns, F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(excluded | (c.skipped == "SKIPPED_DATABASE_EXCLUDED"), "EXCLUDED").when(c.skipped.isNotNull(), "APPROVAL_REVOKED").otherwise("ALLOWED").alias("last_scope_status"),
        workflow.database_status(_Status(excluded, collected)).alias("collection_status"),
    )


class _Status:
    """What ``workflow.database_status`` asks of a database, from the run's own events."""

    def __init__(self, excluded, collected):
        self.is_excluded, self.collected, self.reached = excluded, collected, collected
        self.failed = self.aborted = F.lit(False)
        self.cut_by_window, self.cut_by_scope = c.late > 0, c.skipped.isNotNull()
        self.gate_reason = F.when(c.skipped == "SKIPPED_DATABASE_EXCLUDED", "DATABASE_EXCLUDED").otherwise("SCOPE_ALLOWED")
