"""Choosing the databases of a run: group selectors, explicit lists, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c, Fields, first_match, holds
from statwarden.functions.text import MAX_NAME, list_tokens
from statwarden.operators.scope import TEMP_ID, on_primary, supported_database
from statwarden.operators.skew import lookup

GROUPS = ("ALL", "SYSTEM_DATABASES", "USER_DATABASES")  # fixed values
SYSTEM_IDS = (1, 3, 4)
LAST_SYSTEM_ID = 4


def usable(d: Fields) -> Column:
    """Supported, online, no snapshot, accessible and on its primary replica."""
    return supported_database(c) & (d.state == "ONLINE") & ~d.is_snapshot & holds(d.is_accessible) & on_primary(c)


def in_group(d: Fields, selector: Column, utility_name: str) -> Column:
    """Is the database chosen by a group selector? The utility database never is."""
    member = first_match(
        [
            (selector == "ALL", True),
            (selector == "SYSTEM_DATABASES", d.database_id.isin(*SYSTEM_IDS)),
            (selector == "USER_DATABASES", d.database_id > LAST_SYSTEM_ID),
        ],
        False,
    )
    return (d.database_name != utility_name) & usable(c) & member


def select_group(datasets: DataFrame, selector: str, utility_name: str) -> DataFrame:
    selector = selector.strip().upper()
    if selector not in GROUPS:
        raise ValueError(f"not a group selector: {selector}")
    return datasets.where(in_group(c, F.lit(selector), utility_name))


def resolve_lists(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """Explicit database lists (request_id, listed) -> catalog rows.

    Names are found whatever their case and returned in catalog spelling, once. One
    bad token rejects its whole list; the list then has a single row with the kind
    of violation and no database.
    """
    tokens = requests.select("request_id", F.posexplode(list_tokens(F.col("listed"))).alias("position", "token"))
    catalog = datasets.select(
        F.lower("database_name").alias("name_key"), "database_id", "database_name", supported_database(c).alias("supported")
    )
    found = lookup(tokens.withColumn("name_key", F.lower("token")), catalog, ["name_key"], ["request_id", "position"])
    length = F.length("token")
    kind = first_match(
        [
            ((length == 0) | (length > MAX_NAME), 1),
            (F.upper("token").isin(*GROUPS), 2),
            (F.col("database_id").isNull(), 3),
            (~F.col("supported"), 4),
        ]
    )
    judged = found.select("request_id", "database_id", "database_name", kind.alias("kind"))
    worst = judged.groupBy("request_id").agg(F.min("kind").alias("kind"))
    # fixed values: what is wrong with a list, most basic problem first
    names = {1: "EMPTY_OR_OVERLENGTH", 2: "GROUP_SELECTOR_IN_LIST", 3: "DATABASE_NOT_FOUND", 4: "UNSUPPORTED_DATABASE"}
    rejected = worst.where("kind IS NOT NULL").select(
        "request_id",
        first_match([(F.col("kind") == n, text) for n, text in names.items()]).alias("violation"),
        F.lit(None).cast("bigint").alias("database_id"),
        F.lit(None).cast("string").alias("database_name"),
    )
    accepted = (
        judged.join(worst.where("kind IS NULL").select("request_id"), "request_id", "left_semi")
        .select("request_id", F.lit(None).cast("string").alias("violation"), "database_id", "database_name")
        .distinct()
    )
    return accepted.unionByName(rejected)


def with_selection_status(d: Fields) -> DataFrame:
    """Adds status, reason and readiness to datasets that carry ``is_excluded``."""
    primary = on_primary(c)
    ready = (
        (d.database_id != TEMP_ID) & (d.state == "ONLINE") & holds(d.is_accessible) & ~d.is_snapshot & primary
    )
    return d.select(
        "*",
        first_match([(d.is_excluded, "EXCLUDED"), (~primary, "BLOCKED_SECONDARY")], "SELECTED").alias("selection_status"),
        first_match(
            [(d.is_excluded, "PERSISTENT_DATABASE_EXCLUSION"), (~primary, "ALWAYS_ON_SECONDARY_REPLICA")],
            "REQUESTED_DATABASE",
        ).alias("selection_reason"),
        ready.alias("ready_for_collection"),
        (~holds(d.is_excluded) & ready).alias("will_collect"),
    )


def with_gate(selected: DataFrame, catalog_now: DataFrame, scope_now: DataFrame) -> DataFrame:
    """Re-checks selected databases against the present catalog and scope.

    ``selected``: database_id, database_name, created_at, selection_status, mode.
    ``scope_now``: effective scope (database_id, is_excluded, enabled, scope_error).
    """
    # the name the gate looks up must still be the same database
    now = catalog_now.select(
        "database_id",
        F.struct("database_name", "created_at", usable(c).alias("usable")).alias("now"),
    )
    rules = scope_now.select("database_id", F.struct("is_excluded", "enabled", "scope_error").alias("rule"))
    df = selected.join(now, "database_id", "left").join(rules, "database_id", "left")
    same = (F.col("now.database_name") == c.database_name) & (F.col("now.created_at") == c.created_at)
    broken = ~holds(same) | F.col("rule.scope_error").isNotNull()
    status = first_match(
        [
            (broken, "SCOPE_CHECK_FAILED"),
            ((c.selection_status == "EXCLUDED") | F.col("rule.is_excluded"), "EXCLUDED"),
            ((c.mode == "ENFORCE") & ~holds(F.col("rule.enabled")), "APPROVAL_REVOKED"),
            (~holds(F.col("now.usable")), "DATABASE_UNAVAILABLE"),
        ],
        "ALLOWED",
    )
    df = df.select(*selected.columns, status.alias("last_scope_status"), same.alias("__same"))
    # fixed values: reason and error number per status
    reason = {
        "SCOPE_CHECK_FAILED": "SCOPE_CHECK_FAILED", "EXCLUDED": "DATABASE_EXCLUDED", "APPROVAL_REVOKED": "DATABASE_NOT_APPROVED",
        "DATABASE_UNAVAILABLE": "DATABASE_UNAVAILABLE", "ALLOWED": "SCOPE_ALLOWED",
    }
    s = c.last_scope_status
    return df.select(
        *selected.columns,
        "last_scope_status",
        first_match([(s == k, v) for k, v in reason.items()]).alias("gate_reason"),
        (s == "ALLOWED").alias("can_process"),
        first_match(
            [
                ((s == "SCOPE_CHECK_FAILED") & ~holds(F.col("__same")), 51062),
                (s == "SCOPE_CHECK_FAILED", 51051),
                (s == "APPROVAL_REVOKED", 51040),
                (s == "DATABASE_UNAVAILABLE", 51063),
            ],
            F.lit(None).cast("int"),
        ).alias("gate_error"),
    )


def gate_telemetry_status(status: Column, gate_reason: Column, can_process: Column) -> Column:
    """Pending and blocked work of a database that failed its gate is skipped."""
    open_work = status.isin("PENDING", "BLOCKED_CAPABILITY")
    return first_match(
        [
            (open_work & ~can_process & (gate_reason == "DATABASE_EXCLUDED"), "SKIPPED_DATABASE_EXCLUDED"),
            (open_work & ~can_process, "SKIPPED_SCOPE_BLOCKED"),
        ],
        status,
    )
