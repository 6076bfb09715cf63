"""Whole runs through the public functions."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import statwarden as sw
from statwarden.plans import control, workflows
from statwarden.plans.registry import Inputs
from statwarden.operators import scope, selection
from statwarden.operators.telemetry import STAT_ID

AS_OF = datetime(2024, 1, 15, 12)


@pytest.fixture(scope="module")
def x(spark, sf_dir):
    return Inputs(spark, sf_dir)


@pytest.fixture(scope="module")
def fleet(x):
    clean = x.scope_main.drop("id")
    return sw.Fleet(x.datasets, clean, x.settings.where("database_id = 1"), x.fleet, x.overrides)


@pytest.mark.parametrize(
    "change, code",
    [
        ({"mode": "TRY"}, 51024), ({"databases": "  "}, 51025), ({"statistics_scope": "SOME"}, 51120), ({"maxdop": 0}, 51026), ({"maxdop": 65}, 51026),
        ({"row_floor": -1}, 51027), ({"row_floor": 10, "large_table_rows": 5}, 51027), ({"low_sample_percent": 101}, 51028),
        ({"default_percent": 0}, 51028), ({"legacy_multiplier": 0}, 51028), ({"max_minutes": 525601}, 51029), ({"io_tier": "FAST"}, 51030),
    ],
)
def test_parameters_are_checked(change, code):
    with pytest.raises(sw.GovernanceError) as error:
        sw.GovernanceRequest(**{"databases": "ALL", **change}).checked()
    assert error.value.code == code


@pytest.mark.parametrize(
    "databases, code",
    [("Db_20,,Db_21", 51031), ("ALL,Db_20", 51031), ("nope", 51031), ("tempdb", 51031), ("SSISDB", 51031), ("Db_110", 51031), ("Db_9", 51033), ("Db_13", 51033)],
)
def test_bad_lists_stop_the_run(fleet, databases, code):
    with pytest.raises(sw.GovernanceError) as error:
        sw.govern(sw.GovernanceRequest(databases), fleet, "r", AS_OF)
    assert error.value.code == code


def test_report_run(fleet):
    plan = sw.govern(sw.GovernanceRequest(" db_20 , DB_21,Db_20", mode="recommend", row_floor=0), fleet, "run-1", AS_OF)
    rows = plan.telemetry.collect()
    assert {r.database_name for r in rows} == {"Db_20", "Db_21"}
    assert {r.execution_status for r in rows} <= {"RECOMMENDED", "DEFERRED", "BLOCKED_CAPABILITY"}
    assert all((r.recommended_command is not None) == r.can_execute for r in rows)
    assert plan.run_databases.count() == 2 and plan.runs.count() == 1


def test_observing_proposes_nothing(fleet):
    rows = sw.govern(sw.GovernanceRequest("Db_20", mode="OBSERVE", row_floor=0), fleet, "run-1", AS_OF).telemetry.collect()
    assert rows and all(r.execution_status == "OBSERVED" and r.recommended_command is None for r in rows)


def test_enforcing_needs_approval(fleet):
    with pytest.raises(sw.GovernanceError) as error:
        sw.govern(sw.GovernanceRequest("Db_20", mode="ENFORCE"), fleet, "run-1", AS_OF)
    assert error.value.code == 51036


def test_statistics_scope(fleet):
    def count(scope_name):
        return sw.govern(sw.GovernanceRequest("ALL", statistics_scope=scope_name), fleet, "r", AS_OF).telemetry.count()

    everything, index, auto, user = (count(s) for s in ("ALL", "INDEX_ONLY", "AUTO_ONLY", "USER_ONLY"))
    assert everything == index + auto + user


def test_targeted_run(fleet, x):
    row = x.fleet.where("database_id = 20 AND NOT is_ms_shipped AND NOT is_external").select("schema_name", "table_name").distinct().head()
    name = f" [{row.schema_name.upper()}].{row.table_name.lower()} "
    plan = sw.govern_targeted("Db_20", name, fleet, "r", AS_OF, row_floor=0)
    assert {(r.schema_name, r.table_name) for r in plan.telemetry.collect()} == {(row.schema_name, row.table_name)}


@pytest.mark.parametrize(
    "databases, tables, code",
    [("ALL", "a.b", 51130), ("Db_20,Db_21", "a.b", 51131), ("Db_9", "a.b", 51132), ("Db_20", "a.b,,c.d", 51133), ("Db_20", "a.b.c", 51134), ("Db_20", "onlyone", 51134), ("Db_20", "no.such", 51136)],
)
def test_bad_targets(fleet, databases, tables, code):
    with pytest.raises(sw.GovernanceError) as error:
        sw.govern_targeted(databases, tables, fleet, "r", AS_OF)
    assert error.value.code == code


def test_enforced_run_to_its_end(fleet, x):
    approved = sw.Fleet(
        fleet.datasets, fleet.scope.withColumns({"enabled": F.lit(True), "is_excluded": F.lit(False)}), fleet.settings, fleet.facts, fleet.overrides
    )
    everywhere = x.datasets.select(F.col("database_name").alias("configured_name"), *[F.col(f) for f in ()])
    rows = everywhere.crossJoin(approved.scope.drop("configured_name").limit(1))
    approved = sw.Fleet(approved.datasets, rows.select(*approved.scope.columns), approved.settings, approved.facts, approved.overrides)
    plan = sw.govern(sw.GovernanceRequest("USER_DATABASES", mode="ENFORCE", row_floor=0), approved, "run-9", AS_OF)
    gates = selection.with_gate(
        plan.run_databases.select("run_id", "database_id", "database_name", "created_at", "selection_status", "mode"),
        approved.datasets,
        scope.effective_scope(approved.datasets, approved.scope),
    )
    fresh = x.fresh.selectExpr(
        *x.fleet.columns, "database_id AS fresh_database_id", "schema_name AS fresh_schema_name", "table_name AS fresh_table_name",
        "fresh_stat_name", "fresh_created_at", "fresh_found",
    )
    looked = sw.second_look(plan, gates, fresh, approved.overrides)
    outcomes = looked.where("execution_status = 'PENDING'").selectExpr(*STAT_ID, "IF(stats_id % 50 = 1, 1205, 0) AS action_error")
    after = x.after.selectExpr("'run-9' AS run_id", *STAT_ID[1:], "after_found", "after_rows", "after_rows_sampled", "after_persisted", "after_last_updated")
    final = sw.finish(looked, outcomes, after)
    counts = {r.execution_status: r["count"] for r in final.groupBy("execution_status").count().collect()}
    assert counts["SUCCEEDED"] > 0 and "PENDING" not in counts
    assert final.where("execution_status = 'SUCCEEDED' AND postcheck_status IS NULL").isEmpty()
    summary = sw.summarize(final, plan.run_databases).head()
    assert summary.selected_databases == plan.run_databases.count()
    assert counts.get("FAILED", 0) + counts.get("SKIPPED_REVALIDATION_ERROR", 0) > 0
    assert summary.run_status == "COMPLETED_WITH_ERRORS"


def test_ids_that_repeat_in_every_table_keep_the_row_count(fleet, x):
    """Statistics are numbered 1, 2, ... within each table, tables within each database."""
    number = "row_number() OVER (PARTITION BY database_id, object_id ORDER BY stat_name) AS stats_id"
    renumbered = lambda df: df.selectExpr(*[number if col == "stats_id" else col for col in df.columns])
    some = "database_id IN (20, 21) AND NOT is_ms_shipped AND NOT is_external"
    facts, fresh = renumbered(fleet.facts.where(some)), renumbered(x.fresh.where(some))
    plan = sw.govern(sw.GovernanceRequest("Db_20,Db_21", row_floor=0), replace(fleet, facts=facts), "r", AS_OF)
    planned = plan.telemetry.count()
    assert planned > plan.telemetry.select("stats_id").distinct().count()
    gates = plan.run_databases.selectExpr("run_id", "database_id", "'SCOPE_ALLOWED' AS gate_reason", "true AS can_process", "CAST(NULL AS INT) AS gate_error")
    again = fresh.selectExpr(
        *x.fleet.columns, "database_id AS fresh_database_id", "schema_name AS fresh_schema_name", "table_name AS fresh_table_name",
        "fresh_stat_name", "fresh_created_at", "fresh_found",
    )
    looked = sw.second_look(plan, gates, again, fleet.overrides)
    after = renumbered(x.after.where(some)).selectExpr("'r' AS run_id", *STAT_ID[1:], "after_found", "after_rows", "after_rows_sampled", "after_persisted", "after_last_updated")
    final = sw.finish(looked, looked.selectExpr(*STAT_ID, "0 AS action_error"), after)
    assert (looked.count(), final.count()) == (planned, planned)


def test_deadline_leaves_out_what_it_does_not_reach(fleet, x):
    plan = sw.govern(sw.GovernanceRequest("Db_20,Db_21", row_floor=0, max_minutes=1), fleet, "r", AS_OF)
    work = plan.telemetry.withColumn("execution_status", F.when(F.col("can_execute"), "PENDING").otherwise(F.col("execution_status")))
    costs = work.selectExpr(*STAT_ID, "stats_id % 3 * 10 AS cost_seconds")
    got = {tuple(r[:3]): r[3] for r in sw.within_window(plan, work, costs).select(*STAT_ID[1:], "execution_status").collect()}
    used = 0
    for r in sorted(work.select(*STAT_ID[1:], "execution_status").collect()):
        if r.execution_status == "PENDING":
            assert got[tuple(r[:3])] == ("NOT_STARTED_WINDOW" if used >= 60 else "PENDING")
            used += r.stats_id % 3 * 10
        else:
            assert got[tuple(r[:3])] == r.execution_status
    assert used > 60 and "NOT_STARTED_WINDOW" in got.values()


def test_targets_are_of_the_one_resolved_database(fleet, spark):
    targets = spark.createDataFrame([("Db_21", "s", "t")], "database_name string, schema_name string, table_name string")
    for databases, code in (("Db_20,Db_21", 51122), ("Db_20", 51123)):
        with pytest.raises(sw.GovernanceError) as error:
            sw.govern(sw.GovernanceRequest(databases), fleet, "r", AS_OF, targets)
        assert error.value.code == code


def test_proposed_work_without_a_command_is_reported(fleet):
    from statwarden.operators.telemetry import missing_commands

    rows = sw.govern(sw.GovernanceRequest("Db_20", row_floor=0), fleet, "r", AS_OF).telemetry
    assert missing_commands(rows).isEmpty()
    bare = missing_commands(rows.withColumn("recommended_command", F.lit(None).cast("string")))
    assert {r.violation for r in bare.collect()} == {"51039"} and bare.count() == rows.where("can_execute").count()


def test_several_settings_rows_stop_a_run(fleet):
    twice = replace(fleet, settings=fleet.settings.union(fleet.settings))
    with pytest.raises(sw.GovernanceError) as error:
        sw.govern(sw.GovernanceRequest("Db_20"), twice, "r", AS_OF)
    assert error.value.code == 51037


def test_a_table_without_statistics_is_a_target(fleet, spark):
    tables = spark.createDataFrame([(20, "Db_20", "bare", "Empty")], "database_id long, database_name string, schema_name string, table_name string")
    plan = sw.govern_targeted("Db_20", "bare.empty", replace(fleet, tables=tables), "r", AS_OF)
    assert plan.telemetry.isEmpty()


def test_scope_state_machine(x):
    outcome = control.outcome(x).where("violation IS NULL")
    assert outcome.where("new_excluded AND new_enabled").isEmpty()
    assert outcome.where("new_enabled AND (new_approved_by IS NULL OR new_approved_at IS NULL)").isEmpty()
    assert outcome.where("new_excluded AND (new_exclusion_reason IS NULL OR new_excluded_by IS NULL)").isEmpty()


def test_every_log_entry_has_one_state(x):
    from statwarden.operators.workflow import latest_actions

    events = workflows.action_events(x)
    latest = latest_actions(events)
    assert latest.count() == events.select("action_id").distinct().count()


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_a_statement_that_renames_a_key_is_refused_as_a_whole(spark, hot_rows):
    edits = [
        (1, "A", "A"), (1, "B", "b"), (1, None, "C"), (2, "D", None), (2, None, "E"), (3, "F", "F"), (3, "F", "F"),
        (None, "G", "H"), (None, "I", "I"), (4, None, None), (5, "", "x"),
    ]
    df = spark.createDataFrame(edits, "statement_id long, old_name string, new_name string")
    got = sorted((tuple(r) for r in scope.refuse_renames(df, hot_rows=hot_rows).collect()), key=repr)
    kinds = ["UPDATE", "RENAME", "INSERT", "DELETE", "INSERT", "UPDATE", "UPDATE", "RENAME", "UPDATE", None, "RENAME"]
    bad = [0, 1, 2, 7, 10]
    want = [(*e, k, "51060" if i in bad else None) for i, (e, k) in enumerate(zip(edits, kinds)) if k]
    assert got == sorted(want, key=repr)
    assert scope.refuse_renames(df.where("false")).count() == 0
