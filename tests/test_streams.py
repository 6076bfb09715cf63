"""Streams whose result must not depend on how files fall into batches."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from statwarden.operators import scope
from statwarden.plans import control, streams
from statwarden.plans.registry import Inputs
from statwarden.streaming import modifications, scope_audit


@pytest.mark.parametrize("files_per_batch", [1, 2, 1000])
def test_every_change_is_audited(spark, sf_dir, tmp_path, files_per_batch):
    x = Inputs(spark, sf_dir)
    streams.scope_changes(x).repartition(5).write.parquet(f"{tmp_path}/changes")
    schema = spark.read.parquet(f"{tmp_path}/changes").schema
    stream = modifications.change_stream(spark, f"{tmp_path}/changes", "*.parquet", schema, files_per_batch)
    scope_audit.run_to_end(stream, str(tmp_path))
    start = x.scope.drop("id")
    audit = scope_audit.audit_rows(spark, str(tmp_path), start, schema)
    again = streams.stream_scope_audit(x)
    assert sorted(map(repr, control.flat_audit(audit).collect())) == sorted(map(repr, again.collect()))
    # an entry that is deleted and comes back has both changes
    twice = audit.groupBy("configured_name").agg(F.collect_set("change_type").alias("kinds")).where(F.size("kinds") > 1)
    assert not twice.isEmpty()
    last = scope_audit.snapshot(spark, str(tmp_path), start, schema)
    want = control.scope_after(x).select("configured_name", *scope.SCOPE_FIELDS)
    assert sorted(map(repr, last.collect())) == sorted(map(repr, want.collect()))


def test_counts_over_several_batches_and_hot_keys(spark, tmp_path):
    rows = [(n, n % 7 == 0 and 1 or 2, f"2024-01-0{1 + n % 3}") for n in range(60)]
    events = spark.createDataFrame(rows, "event_id long, k long, day string").selectExpr("event_id", "k", "CAST(day AS timestamp_ntz) AS ts")
    events.repartition(4).write.parquet(f"{tmp_path}/events")
    statistics = spark.createDataFrame([(1,), (2,), (3,)], "k long").selectExpr("k", "timestamp_ntz'2024-01-01' AS last_updated", "1 AS epoch")
    stream = modifications.change_stream(spark, f"{tmp_path}/events", "*.parquet", events.schema, 1)
    modifications.run_to_end(stream, statistics, ["k"], "event_id", f"{tmp_path}/work", hot_rows=1)
    got = {r.k: r.modification_counter for r in modifications.current_counts(spark, f"{tmp_path}/work", ["k"]).collect()}
    later = [k for n, k, day in rows if day > "2024-01-01"]
    assert got == {1: later.count(1), 2: later.count(2), 3: 0}


def test_a_reader_needs_the_folded_counts_and_the_batches_after_them_only(spark, tmp_path):
    """Two runs on one folder; what lies in folded groups is made unreadable between and after them."""
    statistics = spark.createDataFrame([(k,) for k in range(4)], "k long").selectExpr("k", "timestamp_ntz'2024-01-02' AS last_updated", "1 AS epoch")
    want = {k: 0 for k in range(4)}
    work = tmp_path / "work"
    for part in range(2):
        for n in range(5):
            rows = [(part * 50 + n * 10 + i, i % 3, f"2024-01-0{1 + (i + n) % 4}") for i in range(10)]
            for _, k, day in rows:
                want[k] += day > "2024-01-02"
            events = spark.createDataFrame(rows, "event_id long, k long, day string").selectExpr("event_id", "k", "CAST(day AS timestamp_ntz) AS ts")
            events.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = modifications.change_stream(spark, f"{tmp_path}/events", "*.parquet", events.schema, 1)
        modifications.run_to_end(stream, statistics, ["k"], "event_id", str(work), batches_per_group=2)
        last = modifications._last_folded(spark, str(work))
        assert last == (1 if part == 0 else 3)
        for group in range(last + 1):
            for file in (work / "counts" / f"group={group}").rglob("*.parquet"):
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"no table")
        got = {r.k: r.modification_counter for r in modifications.current_counts(spark, str(work), ["k"]).collect()}
        assert got == want


def test_the_last_folded_group_is_found_by_halving(spark, tmp_path):
    for groups in range(10):
        assert modifications._last_folded(spark, str(tmp_path)) == groups - 1
        (tmp_path / "folded" / f"group={groups}").mkdir(parents=True)
        (tmp_path / "folded" / f"group={groups}" / "_SUCCESS").touch()


def _change(seq, name, note, deleted=False):
    return {"seq": seq, "deleted": deleted, "configured_name": name, "notes": note}


def _feed(spark, template, tmp_path, work, batches, lateness):
    """Change rows as files, one a batch, each file later than those before it."""
    for rows in batches:
        made = spark.createDataFrame(rows, "seq int, deleted boolean, configured_name string, notes string")
        empty = template.drop("seq", "deleted", "configured_name", "notes").limit(0)
        full = made.unionByName(empty, allowMissingColumns=True).select(template.columns)
        full.coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
    stream = modifications.change_stream(spark, f"{tmp_path}/changes", "*.parquet", template.schema, 1)
    scope_audit.run_to_end(stream, work, lateness=lateness, batches_per_group=2)


def _kinds(audit):
    rows = audit.select("configured_name", "change_type", F.col("old.notes").alias("was"), F.col("new.notes").alias("now"))
    return sorted((r.configured_name, r.change_type, r.was or "", r.now or "") for r in rows.collect())


def test_closed_changes_are_not_read_again_and_late_ones_are_listed(spark, sf_dir, tmp_path):
    x = Inputs(spark, sf_dir)
    template = streams.scope_changes(x).withColumn("seq", F.col("seq").cast("int")).limit(0)
    start = x.scope.drop("id").limit(0)
    work = f"{tmp_path}/work"
    # out of order inside the allowed lateness of 10
    first = [[_change(20, "a", "a20"), _change(5, "b", "b5")], [_change(12, "a", "a12"), _change(21, "b", "", True)], [_change(40, "c", "c40")], [_change(35, "a", "a35")]]
    _feed(spark, template, tmp_path, work, first, 10)
    want = [("a", "INSERT", "", "a12"), ("a", "UPDATE", "a12", "a20"), ("a", "UPDATE", "a20", "a35"), ("b", "DELETE", "b5", ""), ("b", "INSERT", "", "b5"), ("c", "INSERT", "", "c40")]
    assert _kinds(scope_audit.audit_rows(spark, work, start, template.schema)) == want
    # group 0 is folded up to 21 - 10 = 11, so 11 is late, 13 is not; group 1 closes everything up to 41
    second = [[_change(11, "d", "d11"), _change(31, "a", "a31"), _change(51, "d", "d51")], [_change(52, "d", "d52")]]
    _feed(spark, template, tmp_path, work, second, 10)
    folded = modifications._last_folded(spark, work)
    assert folded == 1
    for part in ("log", "base", "open"):
        for group in range(folded + (part == "log")):
            for file in (tmp_path / "work" / part / f"group={group}").rglob("*.parquet"):
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"no table")
    want = sorted(want + [("a", "UPDATE", "a20", "a31"), ("a", "UPDATE", "a31", "a35"), ("d", "INSERT", "", "d51"), ("d", "UPDATE", "d51", "d52")])
    want.remove(("a", "UPDATE", "a20", "a35"))
    assert _kinds(scope_audit.audit_rows(spark, work, start, template.schema)) == want
    late = [(r.seq, r.notes) for r in scope_audit.late_changes(spark, work, template.schema).collect()]
    assert late == [(11, "d11")]
    last = {r.configured_name: r.notes for r in scope_audit.snapshot(spark, work, start, template.schema).collect()}
    assert last == {"a": "a35", "c": "c40", "d": "d52"}


def test_a_fold_that_is_run_again_gives_the_same_steps(spark, sf_dir, tmp_path, monkeypatch):
    """The first fold of group 1 ends after its steps, base and open changes, before its mark."""
    x = Inputs(spark, sf_dir)
    template = streams.scope_changes(x).withColumn("seq", F.col("seq").cast("int")).limit(0)
    start = x.scope.drop("id").limit(0)
    work = f"{tmp_path}/work"
    log = scope_audit._log

    def stopped(spark, folder, schema, group, late):
        if late and group == 1:
            raise RuntimeError("lost")
        return log(spark, folder, schema, group, late)

    monkeypatch.setattr(scope_audit, "_log", stopped)
    with pytest.raises(StreamingQueryException):
        _feed(spark, template, tmp_path, work, [[_change(n, "a", f"a{n}")] for n in range(1, 6)], 0)
    monkeypatch.setattr(scope_audit, "_log", log)
    assert modifications._last_folded(spark, work) == 0
    want = [("a", "INSERT", "", "a1"), *(("a", "UPDATE", f"a{n}", f"a{n + 1}") for n in range(1, 6))]
    assert _kinds(scope_audit.audit_rows(spark, work, start, template.schema)) == want[:4]
    _feed(spark, template, tmp_path, work, [[_change(6, "a", "a6")]], 0)
    assert modifications._last_folded(spark, work) == 1
    assert _kinds(scope_audit.audit_rows(spark, work, start, template.schema)) == want
