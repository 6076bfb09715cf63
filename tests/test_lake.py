"""Column states, the refresh log, the order of states, and enforcing runs that are stopped and go on."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import statwarden.enforce as enforcing
from statwarden.govern import GovernanceError
from statwarden.operators import collect, profile, states
from statwarden.operators.collect import ColumnStates, RefreshLog
from statwarden.plans import lake as lakes
from statwarden.plans.registry import Inputs

T0 = datetime(2024, 1, 16)


@pytest.fixture
def x(spark, sf_dir):
    return Inputs(spark, sf_dir)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "day string, n int, name string, amount int, tags array<string>")
    return df.withColumn("amount", F.col("amount").cast("decimal(9,2)"))


ROWS = [("a", 1, "x", 1, ["t"]), ("a", None, "y" * 100, 2, None), ("b", 5, None, None, ["u"]), ("b", 7, "z", 3, ["u"]), (None, 3, "y", 9, [])]


def state_rows(states):
    df = states.merged().select("column_name", "rows", "known_rows", F.hll_sketch_estimate("sketch").alias("d"), "low.long_value", "high.text_value")
    return {r.column_name: tuple(r)[1:] for r in df.collect()}


def test_states_merge_and_pieces_come_and_go(spark, tmp_path):
    known = ColumnStates(spark, str(tmp_path))
    df = frame(spark, [(d, n, t, a, g) for d, n, t, a, g in ROWS])
    assert known.version() == 0 and known.merged().count() == 0
    known.add({"t": df.where("day = 'a'")}, {"t": F.col("day")}, T0)
    # a piece that is there already is not added again
    known.add({"t": df.where("day IS NOT NULL")}, {"t": F.col("day")}, T0)
    known.add({"t": df.where("day IS NULL")}, {"t": F.lit("none")}, T0)
    got = state_rows(known)
    assert got["n"] == (5, 4, 4, 1, None) and got["name"] == (5, 4, 4, None, "z") and got["tags"][:2] == (5, 4) and got["tags"][3] is None
    assert known.totals().first()[1:] == (5, 5)
    known.remove(spark.createDataFrame([("t", "b"), ("t", "nope")], "table_name string, piece string"), T0)
    assert state_rows(known)["n"] == (3, 2, 2, 1, None) and known.totals().first()[1:] == (3, 7)
    assert state_rows(known)["name"][4] == "y" * collect.TEXT_CHARACTERS
    known.add({"t": df.where("day = 'b'")}, {"t": F.col("day")}, T0)
    assert state_rows(known) == got and known.totals().first()[1:] == (5, 9)


def test_a_commit_that_was_cut_off_is_written_over(spark, tmp_path):
    known = ColumnStates(spark, str(tmp_path))
    df = frame(spark, ROWS)
    known.add({"t": df.where("day = 'a'")}, {"t": F.col("day")}, T0)
    collect.piece_states(df, "t", F.lit("half")).write.parquet(f"{tmp_path}/states/version=2")
    assert known.version() == 1 and state_rows(known)["n"][0] == 2
    known.add({"t": df.where("day = 'b'")}, {"t": F.col("day")}, T0)
    assert state_rows(known)["n"][0] == 4


def test_sketches_are_near(spark, x, tmp_path):
    known = ColumnStates(spark, str(tmp_path))
    orders = x.table("orders")
    known.add({"orders": orders}, {"orders": lakes.piece("orders")}, T0)
    got = {r.column_name: r.d for r in known.merged().select("column_name", F.hll_sketch_estimate("sketch").alias("d")).collect()}
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in orders.columns]).first().asDict()
    assert all(abs(got[c] - n) <= 0.06 * n + 1 for c, n in exact.items())


def events(spark, *listed):
    rows = [("r", 1, 1, k, seq, state, None, None, T0 + timedelta(seconds=seq)) for k, steps in enumerate(listed) for seq, state in steps]
    return spark.createDataFrame(rows, f"run_id string, database_id int, object_id int, stats_id int, {states.EVENT}")


def test_states_fold_in_order(spark):
    log = events(
        spark,
        [(0, "PENDING"), (3, "EXECUTING"), (4, "SUCCEEDED"), (5, "METADATA_COLLECTED")],
        [(0, "PENDING"), (3, "EXECUTING"), (4, "FAILED"), (4, "FAILED")],
        [(0, "DEFERRED"), (3, "EXECUTING")],
        [(0, "PENDING"), (4, "SUCCEEDED"), (5, "SKIPPED_SCOPE_CHANGE")],
        [(0, "BLOCKED_CAPABILITY"), (1, "SKIPPED_SCOPE_BLOCKED")],
        [(0, "PENDING"), (3, "EXECUTING")],
        [(1, "EXECUTING")],
    )
    got = [(r.execution_status, r.postcheck_status, r.attempted, r.violation) for r in states.folded(log).orderBy("stats_id").collect()]
    assert got == [
        ("SUCCEEDED", "METADATA_COLLECTED", True, None), ("FAILED", None, True, None), ("DEFERRED", None, False, "DEFERRED>EXECUTING"),
        ("PENDING", None, False, "PENDING>SUCCEEDED"), ("SKIPPED_SCOPE_BLOCKED", None, False, None), ("EXECUTING", None, True, None), ("NONE", None, False, "NONE>EXECUTING"),
    ]
    assert {r.stats_id for r in states.violations(log).collect()} == {2, 3, 5, 6}


# ---------------------------------------------------------------- whole runs


@pytest.fixture
def small(spark, x, tmp_path):
    """Customers and suppliers, known and never refreshed."""
    names = {t: x.table(t) for t in ("customer", "supplier")}
    lake = lakes.empty_lake(x, str(tmp_path), tuple(names), second=True)
    lake.states.add(names, {t: F.lit("all") for t in names}, T0)
    return lake, str(tmp_path / "runs")


def run(x, small, run_id="r", clock=lambda: T0, request=lakes.REQUEST, lake=None, **options):
    return enforcing.enforce(request, lakes.control(x), lake or small[0], run_id, T0, small[1], clock, tables_per_unit=1, **options)


def statuses(outcome):
    return {(r.table_name, r.execution_status, r.postcheck_status) for r in outcome.telemetry.collect()}


def test_only_an_enforcing_request(x, small):
    with pytest.raises(GovernanceError):
        run(x, small, request=replace(lakes.REQUEST, mode="RECOMMEND"))


@pytest.mark.parametrize("stop_in", ["refresh_batch", "record", "postchecked"])
def test_a_stopped_run_goes_on_without_a_second_refresh(spark, x, small, monkeypatch, stop_in):
    scans = []
    real = profile.refresh_batch
    target = {"refresh_batch": profile, "record": RefreshLog, "postchecked": enforcing.telemetry}[stop_in]
    original, calls = getattr(target, stop_in), []

    class Killed(BaseException):
        """Like the end of the process: nothing of the run sees it."""

    def killed(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise Killed
        return original(*args, **kwargs)

    def counted(plan, *args, **kwargs):
        scans.append(plan.select("table_name").first()[0])
        return (killed if stop_in == "refresh_batch" else real)(plan, *args, **kwargs)

    monkeypatch.setattr(target, stop_in, killed)
    monkeypatch.setattr(profile, "refresh_batch", counted)
    with pytest.raises(Killed):
        run(x, small)
    outcome = run(x, small)
    assert statuses(outcome) == {("customer", "SUCCEEDED", "METADATA_COLLECTED"), ("supplier", "SUCCEEDED", "METADATA_COLLECTED")}
    # only a refresh that left no results is done again
    assert scans == ["customer", "supplier", "supplier"] if stop_in == "refresh_batch" else scans == ["customer", "supplier"]
    assert small[0].refreshes.entries().count() == 9 and states.violations(outcome.events).isEmpty()
    assert outcome.summary.first().run_status == "COMPLETED"
    if stop_in == "record":  # a finished run is only read
        assert statuses(run(x, small)) == statuses(outcome) and len(scans) == 2


def test_deadline(x, small):
    ticks = iter([T0] * 8 + [T0 + timedelta(minutes=301)] * 100)
    outcome = run(x, small, clock=lambda: next(ticks))
    assert statuses(outcome) == {("customer", "SUCCEEDED", "METADATA_COLLECTED"), ("supplier", "NOT_STARTED_WINDOW", None)}
    row = outcome.databases.first()
    assert row.collection_status == "PARTIAL_WINDOW" and outcome.summary.first().run_status == "WINDOW_EXPIRED"


def test_expected_costs_leave_out_what_the_window_does_not_reach(spark, x, small):
    lake = small[0]
    past = spark.createDataFrame(
        [("customer", "c_name", datetime(2023, 1, 1), 150, 150, 1, 1, 1, 1, None, 0, 400.0)], collect.REFRESHES
    ).withColumn("rows_sampled", F.col("stats_rows"))
    lake.refreshes.record(past, "old", 1)
    outcome = run(x, small, request=replace(lakes.REQUEST, max_minutes=5))
    by_table = {r.table_name: r.execution_status for r in outcome.telemetry.collect()}
    assert by_table == {"customer": "SUCCEEDED", "supplier": "NOT_STARTED_WINDOW"}


def test_scope_that_closes_before_and_after(x, small):
    fleet = lakes.control(x)
    closed = replace(fleet, scope=fleet.scope.withColumn("enabled", F.lit(False)))
    order = iter([fleet, closed] + [closed] * 9)
    outcome = run(x, small, present=lambda: next(order))
    got = statuses(outcome)
    assert got == {("customer", "SUCCEEDED", "SKIPPED_SCOPE_CHANGE"), ("supplier", "SKIPPED_SCOPE_BLOCKED", None)}


def test_a_failed_refresh_and_a_failed_postcheck(x, small, monkeypatch):
    lake = replace(small[0], row_keys={"customer": ["c_custkey"]})  # no keys for the other table
    real = enforcing.telemetry.postchecked

    def broken(done, after):
        if done.select("table_name").distinct().collect()[:1] == []:
            return real(done, after)
        raise RuntimeError("no facts")

    monkeypatch.setattr(enforcing.telemetry, "postchecked", broken)
    outcome = run(x, small, lake=lake)
    assert statuses(outcome) == {("customer", "SUCCEEDED", "COLLECTION_FAILED"), ("supplier", "FAILED", None)}
    assert outcome.summary.first().run_status == "COMPLETED_WITH_ERRORS"


def test_an_abort_is_logged(x, small):
    def fails():
        raise RuntimeError("catalog is gone")

    with pytest.raises(RuntimeError):
        run(x, small, present=fails)
    folder = enforcing.RunFolder(small[0].catalog.sparkSession, f"{small[1]}/r")
    assert {r.execution_status for r in states.folded(folder.events()).collect()} == {"SKIPPED_RUN_ABORTED"}


def test_histograms_of_a_refresh_are_made_once(spark, x, small):
    """The entries of the log are joined to what they are made of, which is read from a table."""
    run(x, small)
    work = spark.read.parquet(f"{small[1]}/r/work-1-*/found")
    assert work.count() == 5 and work.where("after_steps > 0").count() == 5


def test_extremes_of_states_are_plain_while_rows_are_met(spark):
    plan = collect.piece_states(frame(spark, ROWS), "t", F.col("day"))._jdf.queryExecution().optimizedPlan().toString()
    assert "min(n#" in plan or "min(cast(n#" in plan
    assert "min(CASE" not in plan and "min(if" not in plan
