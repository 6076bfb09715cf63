"""Which databases may be governed: scope entries, changes to them, their audit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c, Fields, first_match, holds
from statwarden.functions.text import MAX_NAME, is_blank
from statwarden.operators.skew import HOT_ROWS, lookup

SCOPE_FIELDS = [
    "is_excluded", "exclusion_reason", "excluded_by", "excluded_at",
    "enabled", "approved_by", "approved_at", "notes", "revision",
]
TEMP_ID = 2  # fixed values: the temporary database, and the catalog one never governed
RESERVED_NAME = "SSISDB"
MAX_NOTES = 2000  # fixed value: longest change reason


def supported_database(d: Fields) -> Column:
    return (d.database_id != TEMP_ID) & (d.database_name != RESERVED_NAME) & ~d.is_distributor


def on_primary(d: Fields) -> Column:
    return F.coalesce(d.is_primary, F.lit(True))


def _by_name(scope: DataFrame) -> DataFrame:
    """One row per case-insensitive name, with the number of entries sharing it."""
    return scope.groupBy(F.lower("configured_name").alias("name_key")).agg(
        F.count(F.lit(1)).alias("scope_entries"),
        F.min(F.struct("configured_name", *SCOPE_FIELDS)).alias("entry"),
    )


def effective_scope(datasets: DataFrame, scope: DataFrame) -> DataFrame:
    """Scope of each dataset; defaults when none is configured, an error when several are."""
    df = datasets.withColumn("name_key", F.lower("database_name")).join(_by_name(scope), "name_key", "left")
    ambiguous = holds(c.scope_entries > 1)
    known = F.when(~ambiguous, c.entry)
    flags = ["is_excluded", "enabled"]
    df = df.select(
        "*",
        F.when(~ambiguous, c.scope_entries.isNotNull()).alias("is_configured"),
        F.when(ambiguous, F.lit("51051")).alias("scope_error"),
        known.alias("known"),
        (~ambiguous).alias("clear"),
    )
    df = df.select("*", "known.*").withColumns({name: F.when(c.clear, F.coalesce(name, F.lit(False))) for name in flags})
    return df.drop("name_key", "scope_entries", "entry", "known", "clear")


def configuration_health(scope: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each scope entry against the catalog; the first problem found is reported."""
    catalog = datasets.select(
        F.lower("database_name").alias("name_key"), "database_id", "database_name", "is_distributor", "is_primary"
    )
    entries = scope.withColumn("name_key", F.lower("configured_name"))
    shared = entries.groupBy("name_key").agg(F.count(F.lit(1)).alias("scope_entries"))
    df = entries.join(catalog, "name_key", "left").join(shared, "name_key")
    return df.select(
        *scope.columns,
        F.col("database_name").alias("catalog_name"),
        "database_id",
        first_match(
            [
                (c.database_id.isNull(), "DATABASE_NOT_FOUND"),
                (~supported_database(c), "UNSUPPORTED_DATABASE"),
                (~on_primary(c), "ALWAYS_ON_SECONDARY"),
                (c.scope_entries > 1, "AMBIGUOUS_DATABASE_ALIASES"),
                (c.configured_name != c.database_name, "NONCANONICAL_NAME_REVIEW"),
            ],
            "OK",
        ).alias("configuration_health"),
    )


def alias_conflicts(scope: DataFrame) -> DataFrame:
    """Names under which more than one scope entry is found."""
    return _by_name(scope).where("scope_entries > 1").select("name_key", "scope_entries")


def apply_changes(requests: DataFrame, datasets: DataFrame, scope: DataFrame, as_of: datetime) -> DataFrame:
    """Outcome of each change request: a rule id, or the new scope row.

    A NULL flag keeps the present choice. Exclusion clears the approval; lifting it
    leaves enforcement off unless asked for. ``requests`` holds one per database.
    """
    present = effective_scope(datasets, scope).select(
        F.lower("database_name").alias("name_key"),
        F.struct("database_id", "database_name", supported_database(c).alias("supported"), "is_snapshot").alias("db"),
        F.struct("configured_name", "is_configured", *SCOPE_FIELDS, "scope_error").alias("old"),
    )
    df = requests.select(
        "*", F.trim("requested_name").alias("name"), F.trim("notes").alias("reason"), F.lower(F.trim("requested_name")).alias("name_key")
    ).join(present, "name_key", "left")
    asked_out, asked_on = c.is_excluded, c.enabled
    out = F.coalesce(asked_out, F.col("old.is_excluded"))
    on = F.coalesce(asked_on, F.col("old.enabled"))
    violation = first_match(
        [
            (c.name.isNull() | is_blank(c.name) | (F.length("name") > MAX_NAME), "51054"),
            (c.reason.isNull() | is_blank(c.reason) | (F.length("reason") > MAX_NOTES), "51055"),
            (asked_out.isNull() & asked_on.isNull(), "51056"),
            (~holds(F.col("db.supported") & ~F.col("db.is_snapshot")), "51057"),
            (F.col("old.scope_error").isNotNull(), F.col("old.scope_error")),
            (out & asked_on, "51059"),
        ]
    )
    df = df.select("*", violation.alias("violation"), out.alias("out"), on.alias("on"))
    valid = c.violation.isNull()
    lifted = F.col("old.is_excluded") & asked_on.isNull()
    new_on = ~c.out & ~lifted & c.on
    stamped = new_on & (holds(asked_on) | ~F.col("old.enabled"))
    now = F.lit(as_of).cast("timestamp_ntz")
    return df.select(
        *requests.columns,
        "violation",
        F.when(valid, F.coalesce(F.col("old.configured_name"), F.col("db.database_name"))).alias("new_configured_name"),
        F.when(valid, c.out).alias("new_excluded"),
        F.when(valid, new_on).alias("new_enabled"),
        F.when(valid & c.out, c.reason).alias("new_exclusion_reason"),
        F.when(valid & c.out, c.requested_by).alias("new_excluded_by"),
        F.when(valid & c.out, now).alias("new_excluded_at"),
        F.when(valid & new_on, F.when(stamped, c.requested_by).otherwise(F.col("old.approved_by"))).alias("new_approved_by"),
        F.when(valid & new_on, F.when(stamped, now).otherwise(F.col("old.approved_at"))).alias("new_approved_at"),
        F.when(valid, c.reason).alias("new_notes"),
        F.when(valid, F.when(F.col("old.is_configured"), F.lit("UPDATE")).otherwise(F.lit("INSERT"))).alias("change"),
    )


def next_scope(scope: DataFrame, outcome: DataFrame) -> DataFrame:
    """The scope table after the valid changes; revisions move on by one."""
    changed = outcome.where(F.col("violation").isNull()).select(
        F.col("new_configured_name").alias("configured_name"),
        F.struct(
            F.col("new_excluded").alias("is_excluded"), F.col("new_exclusion_reason").alias("exclusion_reason"),
            F.col("new_excluded_by").alias("excluded_by"), F.col("new_excluded_at").alias("excluded_at"),
            F.col("new_enabled").alias("enabled"), F.col("new_approved_by").alias("approved_by"),
            F.col("new_approved_at").alias("approved_at"), F.col("new_notes").alias("notes"),
        ).alias("new"),
    )
    df = scope.join(changed, "configured_name", "full")
    touched = F.col("new").isNotNull()
    fields = [c for c in SCOPE_FIELDS if c != "revision"]
    return df.select(
        "configured_name",
        *[F.when(touched, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(touched, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"),
    )


def refuse_renames(edits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Kind of each edit, and the rule 51060 for all edits of a statement that renames a key.

    ``edits`` has statement_id, old_name and new_name: a row without old name is an INSERT,
    one without new name a DELETE. A DELETE and an INSERT of one statement are no rename, as
    they are two rows; another spelling of the same name is one. A statement takes effect
    as a whole or not at all. Edits without a statement are judged one by one; an
    edit without any name changes nothing and is left out.
    """
    old, new = F.col("old_name"), F.col("new_name")
    kind = first_match([(old.isNull(), "INSERT"), (new.isNull(), "DELETE"), (old == new, "UPDATE")], "RENAME")
    df = edits.where(old.isNotNull() | new.isNotNull()).withColumn("change_type", kind)
    renaming = df.where("change_type = 'RENAME'").select("statement_id").distinct().withColumn("__renames", F.lit(True))
    judged = lookup(df, renaming, ["statement_id"], ["old_name", "new_name"], hot_rows=hot_rows)
    refused = F.col("__renames") | (F.col("change_type") == "RENAME")
    return judged.withColumn("violation", F.when(refused, F.lit("51060"))).drop("__renames")


def audit_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two scope tables, old and new side by side.

    An entry that did not change is not reported.
    """
    old = before.select("configured_name", F.struct(*SCOPE_FIELDS).alias("old"))
    new = after.select("configured_name", F.struct(*SCOPE_FIELDS).alias("new"))
    return audit_steps(old.join(new, "configured_name", "full"))


def audit_steps(df: DataFrame) -> DataFrame:
    """The rows of (configured_name, old, new) that are a change, with its kind."""
    return df.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        "configured_name",
        first_match([(c.old.isNull(), "INSERT"), (c.new.isNull(), "DELETE")], "UPDATE").alias("change_type"),
        "old",
        "new",
    )

