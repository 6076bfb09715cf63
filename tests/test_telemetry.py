"""Telemetry meets gates, second look and after-snapshots before there is a row per run."""

import pytest
from pyspark.sql import functions as F

from statwarden.operators import telemetry
from statwarden.plans import storage
from statwarden.plans.registry import Inputs
from statwarden.session import prepare


@pytest.mark.parametrize("runs", [(1,), (1, 2, 3)])
def test_rows_per_run_are_those_of_a_left_join(spark, runs):
    """Keys repeat on both sides, are null, or have rows in some runs only."""
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "key long, fact string")
    rows = spark.createDataFrame(
        [(1, 1, "x"), (1, 1, "y"), (1, 1, "x"), (2, 1, "z"), (1, 2, None), (3, 2, "u"), (3, 2, "v"), (1, None, "n"), (2, 9, "w")], "run_id long, key long, v string"
    )
    every = spark.createDataFrame([(r,) for r in runs], "run_id long")
    packed = facts.join(telemetry.per_run(rows, ["key"], "packed"), "key", "left").crossJoin(F.broadcast(every))
    got = telemetry._of_run(packed, "packed").select("run_id", "key", "fact", "v")
    want = facts.crossJoin(every).join(rows, ["run_id", "key"], "left").select("run_id", "key", "fact", "v")
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_no_telemetry_is_shuffled(spark, sf_dir):
    plan = storage.telemetry_table(Inputs(prepare(spark), sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(database_id" in plan
    assert "hashpartitioning(run_id" not in plan
