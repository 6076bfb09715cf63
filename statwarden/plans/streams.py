"""Streaming queries: each must end like its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.operators import scope
from statwarden.plans import control, profiles
from statwarden.plans.registry import Inputs, query
from statwarden.session import work_folder
from statwarden.streaming import modifications, scope_audit


@query("stream_modification_counter", profiles.MODIFICATIONS_SQL)
def stream_modification_counter(x: Inputs) -> DataFrame:
    folder = work_folder(x.spark, "changes")
    statistics = profiles.change_statistics(x).withColumn("epoch", F.lit(1))
    stream = modifications.change_stream(x.spark, x.sf_dir, "events.parquet", x.files("events").schema)
    modifications.run_to_end(stream, statistics, profiles.STATS_KEY, "event_id", folder)
    return modifications.current_counts(x.spark, folder, profiles.STATS_KEY).drop("epoch")


_FIELDS = {"is_excluded": "excluded", "enabled": "enabled", "notes": "notes", "approved_by": "approved_by", "revision": "revision"}


def _sides(old: str, new: str) -> str:
    """Old and new fields; ``old`` and ``new`` are templates for one field."""
    return ", ".join(f"{old.format(f)} AS old_{n}, {new.format(f)} AS new_{n}" for f, n in _FIELDS.items())


def scope_changes(x: Inputs) -> DataFrame:
    """Two changes of each entry that stays, the first of them a deletion for some; one of each that goes."""
    before = x.scope.drop("id")
    final = control.scope_after(x)
    columns = ["configured_name", *scope.SCOPE_FIELDS]
    present = final.select(F.lit(2).alias("seq"), F.lit(False).alias("deleted"), *columns)
    gone = before.join(final.select("configured_name"), "configured_name", "left_anti").select(
        F.lit(2).alias("seq"), F.lit(True).alias("deleted"), *columns
    )
    older = final.select(F.lit(1).alias("seq"), (F.col("revision") % 2 == 0).alias("deleted"), *columns)
    return present.unionByName(gone).unionByName(older)


@query(
    "stream_scope_audit",
    f"""SELECT a.configured_name, CASE WHEN b.configured_name IS NULL THEN 'INSERT' WHEN a.revision % 2 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
          {_sides("b.{}", "CASE WHEN a.revision % 2 <> 0 THEN a.{} END")}
        FROM scope_final a LEFT JOIN scope b ON a.configured_name = b.configured_name
        WHERE CASE WHEN a.revision % 2 = 0 THEN b.configured_name IS NOT NULL ELSE b.configured_name IS NULL OR a.revision <> b.revision END
        UNION ALL
        SELECT a.configured_name, 'INSERT', {_sides("NULL", "a.{}")} FROM scope_final a WHERE a.revision % 2 = 0
        UNION ALL
        SELECT b.configured_name, 'DELETE', {_sides("b.{}", "NULL")} FROM scope b WHERE b.configured_name NOT IN (SELECT configured_name FROM scope_final)""",
    ("datasets", "scope", "scope_requests"),
    (control.SCOPE_SQL, control.CHANGES_SQL, control.AFTER_SQL),
)
def stream_scope_audit(x: Inputs) -> DataFrame:
    """Change files streamed into the log, and every change of it."""
    folder = work_folder(x.spark, "scope_audit")
    scope_changes(x).write.parquet(f"{folder}/changes")
    schema = x.spark.read.parquet(f"{folder}/changes").schema
    scope_audit.run_to_end(modifications.change_stream(x.spark, f"{folder}/changes", "*.parquet", schema), folder)
    return control.flat_audit(scope_audit.audit_rows(x.spark, folder, x.scope.drop("id"), schema))
