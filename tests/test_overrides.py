"""Overrides meet only the facts they may apply to, and thresholds come after all shuffles."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from statwarden.operators import overrides
from statwarden.plans import storage, workflows
from statwarden.plans.registry import Inputs
from statwarden.session import prepare

NOW = datetime(2024, 1, 15, 12)
FACTS = "database_name string, schema_name string, table_name string, stat_name string, n long"


def _overrides(spark, rows):
    """(database, schema, table, stat, id, action) as enabled overrides without an end."""
    names = "database_name string, schema_name string, table_name string, stat_name string, override_id long, action string"
    return spark.createDataFrame(rows, names).selectExpr(
        "*", "CAST(5 AS DECIMAL(9,4)) AS sample_percent", "CAST(NULL AS BIGINT) AS sample_rows", "'KEEP' AS persistence_mode", "true AS force_update",
        "CAST(NULL AS TIMESTAMP_NTZ) AS expires_at", "true AS is_enabled",
    )


def _nodes(plan):
    yield plan
    for child in ("executedPlan", "plan"):
        if plan.nodeName() in ("AdaptiveSparkPlan",) and child == "executedPlan" or plan.nodeName().endswith("QueryStage") and child == "plan":
            yield from _nodes(getattr(plan, child)())
    children = plan.children()
    for i in range(children.length()):
        yield from _nodes(children.apply(i))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan()
    return [node for node in _nodes(plan) if node.nodeName() == "Exchange"]


@pytest.mark.parametrize("marks", [64, overrides.MARKS])
def test_marked_facts_get_the_override_all_facts_would(spark, monkeypatch, marks):
    """Names are null or repeat on both sides; with few marks most facts are marked for nothing."""
    monkeypatch.setattr(overrides, "MARKS", marks)
    rows = [(f"d{n % 3}", "s", f"t{n % 11}", f"x{n}", n) for n in range(300)]
    rows += [(None, "s", "t1", "x1", 300), ("d1", None, "t1", "x1", 301), ("d1", "s", None, "x1", 302), ("d1", "s", "t1", None, 303), rows[7], rows[7], (None, None, None, None, 304)]
    given = [
        ("d1", "s", "t7", "x7", 1, "FORCE_FULLSCAN"), ("d1", "s", "t7", "x7", 2, "EXCLUDE"), ("d1", "s", "t1", None, 3, "EXCLUDE"), ("d1", "s", "t1", "x1", 4, "REFRESH_AUTO"),
        ("d0", "s", "t2", None, 5, "REFRESH_AUTO"), ("d9", "s", "t2", "x", 6, "EXCLUDE"), (None, "s", "t1", "x1", 7, "EXCLUDE"), (None, "s", "t1", None, 8, "EXCLUDE"),
        ("d1", "s", None, None, 9, "EXCLUDE"), ("d1", "s", "t4", None, 10, "EXCLUDE"), ("d1", "s", "t4", "x4", 11, "FORCE_FULLSCAN"),
    ]
    facts, approved = spark.createDataFrame(rows, FACTS), _overrides(spark, given)
    plain = overrides.with_winning_override(facts, approved, NOW)
    got = overrides.with_winning_override(facts, approved, NOW, read_twice=True)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert sorted(got.collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert plain.where("o_override_id IS NOT NULL").count() > 10


def test_only_facts_an_override_may_apply_to_are_shuffled(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        facts = spark.range(20_000).selectExpr("concat('d', id % 7) AS database_name", "'s' AS schema_name", "concat('t', id) AS table_name", "concat('x', id) AS stat_name", "id AS n")
        approved = _overrides(spark, [(f"d{n % 7}", "s", f"t{n}", f"x{n}" if n % 2 else None, n, "EXCLUDE") for n in range(0, 500, 5)])
        df = overrides.with_winning_override(facts, approved, NOW, sizes=facts, read_twice=True)
        assert sum(r.o_override_id is not None for r in df.collect()) == 100
        written = [node.metrics().apply("shuffleRecordsWritten").value() for node in _exchanges(df)]
        assert written and max(written) < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_thresholds_are_not_shuffled(spark, sf_dir):
    """Facts meet overrides, gates, second look and after-snapshots before their thresholds are worked out."""
    exchanges = _exchanges(storage.telemetry_table(Inputs(prepare(spark), sf_dir)))
    columns = [node.output().mkString(",") for node in exchanges]
    assert any("modification_counter" in text for text in columns)
    assert not any(name in text for text in columns for name in ("native_threshold", "native_policy", "native_state", "stats_age_minutes"))


def test_large_scans_are_held_against_marks(spark, sf_dir):
    """A scan of as many splits as cores is sifted in the scan; one of fewer is dealt out as it is."""
    from statwarden.plans.decisions import joined

    def marked():
        plan = joined(Inputs(prepare(spark), sf_dir))._jdf.queryExecution().optimizedPlan().toString()
        return "bit_or" in plan

    assert not marked()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert marked()
        df = joined(Inputs(prepare(spark), sf_dir)).where(F.col("o_override_id").isNotNull())
        some = sorted(df.select("stats_id", "policy_id", "o_override_id").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    df = joined(Inputs(prepare(spark), sf_dir)).where(F.col("o_override_id").isNotNull())
    assert some and some == sorted(df.select("stats_id", "policy_id", "o_override_id").collect())


@pytest.fixture
def many_splits(spark):
    """Scans of more splits than cores, and no table small enough to broadcast unasked, as with large tables."""
    given = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in given.items():
        spark.conf.set(key, value)
    yield
    for key in given:
        spark.conf.unset(key)


def _records(df, columns):
    """Rows that a query's exchanges of at least so many columns wrote."""
    df.collect()
    wide = [node for node in _exchanges(df) if node.output().length() >= columns]
    return [node.metrics().apply("shuffleRecordsWritten").value() for node in wide]


def test_the_action_log_does_not_shuffle_the_facts(spark, sf_dir, many_splits):
    """The actions of topn_recent and scan_recent_inventory come from decisions, whose facts mostly have no override."""
    x = Inputs(prepare(spark), sf_dir)
    written = _records(workflows.action_events(x), 10)
    assert written and max(written) < x.fleet.count() / 2


def test_telemetry_shuffles_its_facts_twice_at_most(spark, sf_dir, many_splits):
    """Once by database, once by statistic; fresh facts and overrides add the marked ones only."""
    x = Inputs(prepare(spark), sf_dir)
    written = _records(storage.telemetry_table(x), 30)
    assert written and sum(written) < 3 * x.fleet.count()
