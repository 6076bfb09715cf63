"""Queries over control frames: selection, scope, gates, audit, rules, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c
from statwarden.operators import capability, checks, scope, selection
from statwarden.plans.decisions import AS_OF_TIME
from statwarden.plans.fixtures import AS_OF
from statwarden.plans.registry import Inputs, query

UTILITY = "GovernanceDb"
SELECTORS = ("ALL", "SYSTEM_DATABASES", "USER_DATABASES")

SUPPORTED = "database_id <> 2 AND database_name <> 'SSISDB' AND NOT is_distributor"
USABLE = f"({SUPPORTED} AND state = 'ONLINE' AND NOT is_snapshot AND is_accessible AND coalesce(is_primary, true))"


@query(
    "filter_group_selector",
    f"""SELECT selector, database_id, database_name FROM datasets
        CROSS JOIN (VALUES ('ALL'), ('SYSTEM_DATABASES'), ('USER_DATABASES')) s(selector)
        WHERE database_name <> 'GovernanceDb' AND {USABLE}
          AND (selector = 'ALL' OR (selector = 'SYSTEM_DATABASES' AND database_id IN (1, 3, 4)) OR (selector = 'USER_DATABASES' AND database_id > 4))""",
    ("datasets",),
)
def filter_group_selector(x: Inputs) -> DataFrame:
    result = None
    for name in SELECTORS:
        chosen = selection.select_group(x.datasets, name, UTILITY).select(F.lit(name).alias("selector"), "database_id", "database_name")
        result = chosen if result is None else result.unionByName(chosen)
    return result


# one explicit list per database; the six kinds of list come in turn
_LIST_KINDS = {
    1: "concat(lower(database_name), ',,', database_name)",
    2: "concat('All,', database_name)",
    3: "concat(database_name, ',nope_', cast(database_id as string))",
    4: "concat(database_name, ', tempdb')",
    5: "concat('master , ', database_name, ' ,MASTER')",
}
_LISTED = "CASE database_id % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _LIST_KINDS.items()) + " ELSE concat('  ', upper(database_name), ',', database_name, ' ') END"

LISTS_SQL = f"""
lists AS (SELECT database_id AS request_id, {_LISTED} AS listed FROM datasets),
tokens AS (SELECT request_id, trim(t.token) AS token FROM lists, unnest(string_split(listed, ',')) AS t(token)),
judged AS (
  SELECT t.request_id, d.database_id, d.database_name,
    CASE WHEN length(t.token) = 0 OR length(t.token) > 128 THEN 1
         WHEN upper(t.token) IN ('ALL', 'SYSTEM_DATABASES', 'USER_DATABASES') THEN 2
         WHEN d.database_id IS NULL THEN 3
         WHEN d.database_id = 2 OR d.database_name = 'SSISDB' OR d.is_distributor THEN 4 END AS kind
  FROM tokens t LEFT JOIN datasets d ON lower(d.database_name) = lower(t.token)),
worst AS (SELECT request_id, min(kind) AS kind FROM judged GROUP BY request_id)"""


def lists(x: Inputs) -> DataFrame:
    return x.datasets.select(F.col("database_id").alias("request_id"), F.expr(_LISTED).alias("listed"))


@query(
    "filter_explicit_list",
    """SELECT DISTINCT j.request_id, CAST(NULL AS VARCHAR) AS violation, j.database_id, j.database_name
       FROM judged j JOIN worst w ON w.request_id = j.request_id AND w.kind IS NULL
       UNION ALL
       SELECT request_id, CASE kind WHEN 1 THEN 'EMPTY_OR_OVERLENGTH' WHEN 2 THEN 'GROUP_SELECTOR_IN_LIST'
         WHEN 3 THEN 'DATABASE_NOT_FOUND' ELSE 'UNSUPPORTED_DATABASE' END, NULL, NULL FROM worst WHERE kind IS NOT NULL""",
    ("datasets",),
    (LISTS_SQL,),
)
def filter_explicit_list(x: Inputs) -> DataFrame:
    return selection.resolve_lists(lists(x), x.datasets)


@query(
    "agg_distinct",
    """SELECT DISTINCT j.request_id, j.database_id FROM judged j WHERE j.database_id IS NOT NULL""",
    ("datasets",),
    (LISTS_SQL,),
)
def agg_distinct(x: Inputs) -> DataFrame:
    """Databases named by each list, once, valid list or not."""
    tokens = lists(x).select("request_id", F.explode(F.transform(F.split("listed", ",", -1), lambda t: F.lower(F.trim(t)))).alias("name_key"))
    known = x.datasets.select(F.lower("database_name").alias("name_key"), "database_id")
    return tokens.distinct().join(known, "name_key").select("request_id", "database_id").distinct()


SCOPE_SQL = """
entries AS (SELECT lower(configured_name) AS name_key, count(*) AS n FROM scope GROUP BY ALL),
effective AS (
  SELECT d.database_id, d.database_name, coalesce(e.n, 0) > 1 AS clash, s.configured_name,
    CASE WHEN coalesce(e.n, 0) <= 1 THEN e.n IS NOT NULL END AS is_configured,
    CASE WHEN coalesce(e.n, 0) <= 1 THEN coalesce(s.is_excluded, false) END AS is_excluded,
    CASE WHEN coalesce(e.n, 0) <= 1 THEN coalesce(s.enabled, false) END AS enabled,
    s.exclusion_reason, s.excluded_by, s.excluded_at, s.approved_by, s.approved_at, s.notes, s.revision,
    CASE WHEN e.n > 1 THEN '51051' END AS scope_error
  FROM datasets d LEFT JOIN entries e ON e.name_key = lower(d.database_name)
    LEFT JOIN scope s ON lower(s.configured_name) = lower(d.database_name) AND e.n = 1)"""


@query(
    "scope_lookup_fleet",
    """SELECT database_id, configured_name, is_configured, is_excluded, enabled, exclusion_reason, excluded_by, excluded_at,
         approved_by, approved_at, notes, revision, scope_error FROM effective""",
    ("datasets", "scope"),
    (SCOPE_SQL,),
)
def scope_lookup_fleet(x: Inputs) -> DataFrame:
    return scope.effective_scope(x.datasets, x.scope).select(
        "database_id", "configured_name", "is_configured", "is_excluded", "enabled", "exclusion_reason", "excluded_by",
        "excluded_at", "approved_by", "approved_at", "notes", "revision", "scope_error",
    )


@query(
    "src_scope",
    "SELECT configured_name, is_excluded, enabled, exclusion_reason, excluded_by, approved_by, notes, revision FROM scope",
    ("scope",),
)
def src_scope(x: Inputs) -> DataFrame:
    return x.scope.select("configured_name", "is_excluded", "enabled", "exclusion_reason", "excluded_by", "approved_by", "notes", "revision")


@query("agg_alias_conflicts", "SELECT name_key, n AS scope_entries FROM entries WHERE n > 1", ("datasets", "scope"), (SCOPE_SQL,))
def agg_alias_conflicts(x: Inputs) -> DataFrame:
    return scope.alias_conflicts(x.scope)


@query(
    "view_scope_configuration",
    f"""SELECT s.*, d.database_name AS catalog_name, d.database_id,
          CASE WHEN d.database_id IS NULL THEN 'DATABASE_NOT_FOUND' WHEN NOT ({SUPPORTED}) THEN 'UNSUPPORTED_DATABASE'
               WHEN coalesce(is_primary, true) = false THEN 'ALWAYS_ON_SECONDARY'
               WHEN (SELECT n FROM entries e WHERE e.name_key = lower(s.configured_name)) > 1 THEN 'AMBIGUOUS_DATABASE_ALIASES'
               WHEN s.configured_name <> d.database_name THEN 'NONCANONICAL_NAME_REVIEW' ELSE 'OK' END AS configuration_health
        FROM (SELECT * EXCLUDE (id) FROM scope) s LEFT JOIN datasets d ON lower(d.database_name) = lower(s.configured_name)""",
    ("datasets", "scope"),
    (SCOPE_SQL,),
)
def view_scope_configuration(x: Inputs) -> DataFrame:
    return scope.configuration_health(x.scope.drop("id"), x.datasets)


CHANGES_SQL = f"""
asked AS (
  SELECT q.*, trim(q.requested_name) AS nm, trim(q.notes) AS rs, d.database_id, d.database_name,
    d.database_id <> 2 AND d.database_name <> 'SSISDB' AND NOT d.is_distributor AND NOT d.is_snapshot AS okdb, e.clash, e.configured_name AS old_name, e.is_configured AS old_configured, e.is_excluded AS old_out, e.enabled AS old_on,
    e.approved_by AS old_by, e.approved_at AS old_at
  FROM scope_requests q LEFT JOIN datasets d ON lower(d.database_name) = lower(trim(q.requested_name))
    LEFT JOIN effective e USING (database_id)),
judged_requests AS (
  SELECT *, coalesce(is_excluded, old_out) AS o, coalesce(enabled, old_on) AS n0,
    CASE WHEN nm IS NULL OR length(nm) = 0 OR length(nm) > 128 THEN '51054'
         WHEN rs IS NULL OR length(rs) = 0 OR length(rs) > 2000 THEN '51055'
         WHEN is_excluded IS NULL AND enabled IS NULL THEN '51056'
         WHEN okdb IS DISTINCT FROM true THEN '51057'
         WHEN clash THEN '51051'
         WHEN coalesce(is_excluded, old_out) AND enabled THEN '51059' END AS violation
  FROM asked),
settled AS (
  SELECT *, NOT o AND n0 AND NOT (old_out AND enabled IS NULL) AS n1 FROM judged_requests),
outcome AS (
  SELECT id, requested_name, is_excluded, enabled, notes, requested_by, violation,
    CASE WHEN violation IS NULL THEN coalesce(old_name, database_name) END AS new_configured_name,
    CASE WHEN violation IS NULL THEN o END AS new_excluded,
    CASE WHEN violation IS NULL THEN n1 END AS new_enabled,
    CASE WHEN violation IS NULL AND o THEN rs END AS new_exclusion_reason,
    CASE WHEN violation IS NULL AND o THEN requested_by END AS new_excluded_by,
    CASE WHEN violation IS NULL AND o THEN TIMESTAMP '{AS_OF}' END AS new_excluded_at,
    CASE WHEN violation IS NULL AND n1 THEN CASE WHEN coalesce(enabled, false) OR NOT old_on THEN requested_by ELSE old_by END END AS new_approved_by,
    CASE WHEN violation IS NULL AND n1 THEN CASE WHEN coalesce(enabled, false) OR NOT old_on THEN TIMESTAMP '{AS_OF}' ELSE old_at END END AS new_approved_at,
    CASE WHEN violation IS NULL THEN rs END AS new_notes,
    CASE WHEN violation IS NULL THEN CASE WHEN old_configured THEN 'UPDATE' ELSE 'INSERT' END END AS change
  FROM settled)"""


def outcome(x: Inputs) -> DataFrame:
    return scope.apply_changes(x.scope_requests, x.datasets, x.scope, AS_OF_TIME)


@query("scope_apply_changes", "SELECT * FROM outcome", ("datasets", "scope", "scope_requests"), (SCOPE_SQL, CHANGES_SQL))
def scope_apply_changes(x: Inputs) -> DataFrame:
    return outcome(x)


@query(
    "scope_refuse_renames",
    """SELECT statement_id, old_name, new_name, change_type,
         CASE WHEN bool_or(change_type = 'RENAME') OVER (PARTITION BY statement_id) THEN '51060' END AS violation
       FROM (SELECT CAST(coalesce(d.database_id, s.id) // 20 AS BIGINT) AS statement_id, s.configured_name AS old_name, d.database_name AS new_name,
               CASE WHEN s.configured_name IS NULL THEN 'INSERT' WHEN d.database_name IS NULL THEN 'DELETE'
                    WHEN s.configured_name = d.database_name THEN 'UPDATE' ELSE 'RENAME' END AS change_type
             FROM scope s FULL JOIN datasets d ON lower(s.configured_name) = lower(d.database_name))""",
    ("datasets", "scope"),
)
def scope_refuse_renames(x: Inputs) -> DataFrame:
    """Statements that bring the scope's names in line with the catalog, twenty databases each; a changed spelling is refused."""
    entries = x.scope.select("id", F.col("configured_name").alias("old_name"))
    present = x.datasets.select("database_id", F.col("database_name").alias("new_name"))
    paired = entries.join(present, F.lower("old_name") == F.lower("new_name"), "full")
    statement = F.call_function("div", F.coalesce("database_id", "id").cast("bigint"), F.lit(20).cast("bigint"))
    return scope.refuse_renames(paired.select(statement.alias("statement_id"), "old_name", "new_name"))


AFTER_SQL = """
changed AS (SELECT * FROM outcome WHERE violation IS NULL),
scope_after AS (
  SELECT s.configured_name, s.is_excluded, s.exclusion_reason, s.excluded_by, s.excluded_at, s.enabled, s.approved_by, s.approved_at, s.notes, s.revision
  FROM scope s WHERE s.configured_name NOT IN (SELECT new_configured_name FROM changed)
  UNION ALL
  SELECT new_configured_name, new_excluded, new_exclusion_reason, new_excluded_by, new_excluded_at, new_enabled, new_approved_by, new_approved_at,
    new_notes, coalesce(s.revision, 0) + 1
  FROM changed c LEFT JOIN scope s ON s.configured_name = c.new_configured_name),
scope_final AS (SELECT * FROM scope_after WHERE revision % 49 <> 0)"""


def scope_after(x: Inputs) -> DataFrame:
    """Scope after the requested changes; some entries were deleted as well."""
    return scope.next_scope(x.scope.drop("id"), outcome(x)).where("revision % 49 <> 0")


@query(
    "audit_scope_diff",
    """SELECT coalesce(a.configured_name, b.configured_name) AS configured_name,
         CASE WHEN b.configured_name IS NULL THEN 'INSERT' WHEN a.configured_name IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
         b.is_excluded AS old_excluded, a.is_excluded AS new_excluded, b.enabled AS old_enabled, a.enabled AS new_enabled,
         b.notes AS old_notes, a.notes AS new_notes, b.approved_by AS old_approved_by, a.approved_by AS new_approved_by,
         b.revision AS old_revision, a.revision AS new_revision
       FROM scope_final a FULL JOIN scope b ON a.configured_name = b.configured_name
       WHERE a.configured_name IS NULL OR b.configured_name IS NULL OR a.revision <> b.revision""",
    ("datasets", "scope", "scope_requests"),
    (SCOPE_SQL, CHANGES_SQL, AFTER_SQL),
)
def audit_scope_diff(x: Inputs) -> DataFrame:
    return audit_rows(x)


def audit_rows(x: Inputs) -> DataFrame:
    return flat_audit(scope.audit_diff(x.scope, scope_after(x)))


def flat_audit(audit: DataFrame) -> DataFrame:
    names = {"is_excluded": "excluded", "enabled": "enabled", "notes": "notes", "approved_by": "approved_by", "revision": "revision"}
    return audit.select(
        "configured_name",
        "change_type",
        *[F.col(f"{side}.{field}").alias(f"{side}_{name}") for field, name in names.items() for side in ("old", "new")],
    )


SELECTION_SQL = """
selected AS (
  SELECT d.*, e.is_excluded, e.enabled, e.exclusion_reason, e.scope_error,
    CASE WHEN e.is_excluded THEN 'EXCLUDED' WHEN NOT coalesce(d.is_primary, true) THEN 'BLOCKED_SECONDARY' ELSE 'SELECTED' END AS selection_status,
    CASE WHEN e.is_excluded THEN 'PERSISTENT_DATABASE_EXCLUSION' WHEN NOT coalesce(d.is_primary, true) THEN 'ALWAYS_ON_SECONDARY_REPLICA' ELSE 'REQUESTED_DATABASE' END AS selection_reason,
    d.database_id <> 2 AND state = 'ONLINE' AND is_accessible AND NOT is_snapshot AND coalesce(is_primary, true) AS ready_for_collection
  FROM datasets d JOIN effective e USING (database_id, database_name))"""


def selected(x: Inputs) -> DataFrame:
    return selection.with_selection_status(scope.effective_scope(x.datasets, x.scope))


@query(
    "proj_selection_status",
    """SELECT database_id, database_name, selection_status, selection_reason, ready_for_collection,
         ready_for_collection AND NOT coalesce(is_excluded, false) AS will_collect, exclusion_reason FROM selected""",
    ("datasets", "scope"),
    (SCOPE_SQL, SELECTION_SQL),
)
def proj_selection_status(x: Inputs) -> DataFrame:
    return selected(x).select(
        "database_id", "database_name", "selection_status", "selection_reason", "ready_for_collection", "will_collect", "exclusion_reason"
    )


GATE_SQL = f"""
now_catalog AS (
  SELECT database_id, now_name AS database_name, now_created AS created_at, now_state AS state, is_distributor, is_snapshot, is_accessible, is_primary
  FROM datasets_now),
scope_now AS (
  SELECT database_id, is_excluded IS TRUE OR database_id % 33 = 1 AS is_excluded, enabled IS TRUE AND database_id % 21 <> 3 AS enabled, scope_error
  FROM effective),
gate_in AS (SELECT s.database_id, s.database_name, s.created_at, s.selection_status, p.policy_id AS run_id, p.mode FROM selected s CROSS JOIN policy p),
gate0 AS (
  SELECT g.*, n.database_name = g.database_name AND n.created_at = g.created_at AS same, r.is_excluded, r.enabled, r.scope_error,
    {USABLE.replace('database_name', 'n.database_name').replace('database_id', 'n.database_id')} AS usable
  FROM gate_in g LEFT JOIN now_catalog n USING (database_id) LEFT JOIN scope_now r USING (database_id)),
gated AS (
  SELECT *, CASE WHEN same IS DISTINCT FROM true OR scope_error IS NOT NULL THEN 'SCOPE_CHECK_FAILED'
      WHEN selection_status = 'EXCLUDED' OR is_excluded THEN 'EXCLUDED'
      WHEN mode = 'ENFORCE' AND NOT enabled THEN 'APPROVAL_REVOKED'
      WHEN usable IS DISTINCT FROM true THEN 'DATABASE_UNAVAILABLE' ELSE 'ALLOWED' END AS last_scope_status
  FROM gate0)"""

GATE_FRAMES = ("datasets", "scope", "datasets_now", "policy")
GATE_PARTS = (SCOPE_SQL, SELECTION_SQL, GATE_SQL)


def gated(x: Inputs) -> DataFrame:
    """Every database of every run through the gate, against a later catalog and scope."""
    runs = x.policies.select(F.col("policy_id").alias("run_id"), "mode")
    chosen = selected(x)
    work = chosen.select("database_id", "database_name", "created_at", "selection_status").crossJoin(F.broadcast(runs))
    now = x.datasets_now.select(
        "database_id", F.col("now_name").alias("database_name"), F.col("now_created").alias("created_at"), F.col("now_state").alias("state"),
        "is_distributor", "is_snapshot", "is_accessible", "is_primary",
    )
    rules = scope.effective_scope(x.datasets, x.scope).select(
        "database_id",
        (F.coalesce("is_excluded", F.lit(False)) | (F.col("database_id") % 33 == 1)).alias("is_excluded"),
        (F.coalesce("enabled", F.lit(False)) & (F.col("database_id") % 21 != 3)).alias("enabled"),
        "scope_error",
    )
    return selection.with_gate(work, now, rules)


@query(
    "gate_check",
    """SELECT run_id, database_id, last_scope_status,
         CASE last_scope_status WHEN 'EXCLUDED' THEN 'DATABASE_EXCLUDED' WHEN 'APPROVAL_REVOKED' THEN 'DATABASE_NOT_APPROVED'
           WHEN 'ALLOWED' THEN 'SCOPE_ALLOWED' ELSE last_scope_status END AS gate_reason,
         last_scope_status = 'ALLOWED' AS can_process,
         CASE last_scope_status WHEN 'SCOPE_CHECK_FAILED' THEN CASE WHEN same THEN 51051 ELSE 51062 END
           WHEN 'APPROVAL_REVOKED' THEN 51040 WHEN 'DATABASE_UNAVAILABLE' THEN 51063 END AS gate_error
       FROM gated""",
    GATE_FRAMES,
    GATE_PARTS,
)
def gate_check(x: Inputs) -> DataFrame:
    return gated(x).select("run_id", "database_id", "last_scope_status", "gate_reason", "can_process", "gate_error")


# ---------------------------------------------------------------- rules


@query(
    "check_override_constraints",
    """SELECT CAST(override_id AS VARCHAR) AS subject, 'approval' AS rule, CAST(1 AS BIGINT) AS entries FROM overrides
         WHERE NOT (length(trim(approved_by)) > 0 AND length(trim(notes)) > 0 AND (expires_at IS NULL OR expires_at > approved_at))
       UNION ALL SELECT CAST(override_id AS VARCHAR), 'force_expiry', 1 FROM overrides WHERE force_update AND (expires_at IS NULL OR action = 'EXCLUDE')
       UNION ALL SELECT CAST(override_id AS VARCHAR), 'persistence', 1 FROM overrides
         WHERE (action IN ('REFRESH_AUTO', 'EXCLUDE') AND persistence_mode <> 'KEEP') OR (action = 'FORCE_SAMPLE_ROWS' AND persistence_mode = 'ON')
       UNION ALL SELECT CAST(override_id AS VARCHAR), 'sample', 1 FROM overrides
         WHERE NOT coalesce(CASE action WHEN 'FORCE_SAMPLE_PERCENT' THEN sample_percent > 0 AND sample_percent <= 100 AND sample_rows IS NULL
           WHEN 'FORCE_SAMPLE_ROWS' THEN sample_rows > 0 AND sample_percent IS NULL
           ELSE sample_percent IS NULL AND sample_rows IS NULL END, false)
       UNION ALL SELECT database_name || '.' || schema_name || '.' || table_name, 'one_per_table', count(*) FROM overrides
         WHERE stat_name IS NULL GROUP BY database_name, schema_name, table_name HAVING count(*) > 1
       UNION ALL SELECT database_name || '.' || schema_name || '.' || table_name || '.' || stat_name, 'one_per_statistic', count(*) FROM overrides
         WHERE stat_name IS NOT NULL GROUP BY database_name, schema_name, table_name, stat_name HAVING count(*) > 1""",
    ("overrides",),
)
def check_override_constraints(x: Inputs) -> DataFrame:
    return checks.override_violations(x.overrides)


@query(
    "check_scope_constraints",
    """SELECT configured_name, 'approval' AS rule, CAST(1 AS BIGINT) AS entries FROM scope
         WHERE length(trim(notes)) = 0 OR (enabled AND (approved_by IS NULL OR length(trim(approved_by)) = 0 OR approved_at IS NULL))
       UNION ALL SELECT configured_name, 'exclusion', 1 FROM scope
         WHERE is_excluded AND (enabled OR exclusion_reason IS NULL OR excluded_by IS NULL OR excluded_at IS NULL)
       UNION ALL SELECT configured_name, 'one_per_name', count(*) FROM scope GROUP BY configured_name HAVING count(*) > 1""",
    ("scope",),
)
def check_scope_constraints(x: Inputs) -> DataFrame:
    return checks.scope_violations(x.scope)


@query(
    "check_settings_constraints",
    """SELECT database_id, unnest(list_filter([
         CASE WHEN settings_id <> 1 THEN 'singleton' END, CASE WHEN schema_version <> '1.3.0' THEN 'schema_version' END,
         CASE WHEN NOT (moderate_skew_percent >= 0 AND moderate_skew_percent < high_skew_percent AND high_skew_percent < extreme_skew_percent
           AND extreme_skew_percent <= 100 AND high_skew_sample_rows > 0 AND extreme_skew_sample_rows >= high_skew_sample_rows) THEN 'skew_policy' END,
         CASE WHEN NOT (update_threshold_percent > 0 AND min_modification_count >= 0 AND min_update_interval_minutes >= 0
           AND lock_timeout_ms BETWEEN 0 AND 600000) THEN 'ranges' END], lambda r: r IS NOT NULL)) AS rule
       FROM settings""",
    ("settings",),
)
def check_settings_constraints(x: Inputs) -> DataFrame:
    settings = x.settings
    return checks.violations(settings, ["database_id"], checks.settings_rules(c))


@query(
    "src_policy",
    """SELECT s.database_id, r.*, s.update_threshold_percent, CAST(s.min_modification_count AS BIGINT) AS min_modifications, CAST(s.min_update_interval_minutes AS INT) AS cooldown_minutes,
         s.skew_sampling_enabled AS skew_enabled, s.lock_timeout_ms,
         CASE WHEN settings_id = 1 AND schema_version = '1.3.0' THEN NULL ELSE '51037' END AS policy_error
       FROM settings s CROSS JOIN (SELECT policy_id, mode, row_floor, default_percent FROM policy) r""",
    ("settings", "policy"),
)
def src_policy(x: Inputs) -> DataFrame:
    """Effective policy per database: its settings row with the parameters of the run."""
    calls = x.policies.select("policy_id", "mode", "row_floor", "default_percent")
    s = x.settings
    usable = (s.settings_id == 1) & (s.schema_version == checks.SETTINGS_VERSION)
    return s.crossJoin(F.broadcast(calls)).select(
        "database_id", *calls.columns, "update_threshold_percent",
        F.col("min_modification_count").cast("bigint").alias("min_modifications"),
        F.col("min_update_interval_minutes").cast("int").alias("cooldown_minutes"),
        F.col("skew_sampling_enabled").alias("skew_enabled"), "lock_timeout_ms",
        F.when(~usable, F.lit("51037")).alias("policy_error"),
    )


# ---------------------------------------------------------------- capability

VERSION_PARTS = "list_transform(string_split(product_version, '.'), lambda p: try_cast(p AS INT))"


CAP_SQL = f"""SELECT id, product_version, engine_edition, a AS product_major, b AS product_minor, c AS product_build, d AS product_revision,
          managed OR ruled AS supported_engine,
          CASE WHEN managed THEN 'MANAGED_INSTANCE_SERVICE_CAPABILITIES' WHEN ruled THEN 'DOCUMENTED_BUILD_RULES' ELSE 'UNRECOGNIZED_ENGINE_OR_VERSION' END AS build_rule_status,
          CASE WHEN managed THEN true WHEN ruled THEN a <> 13 OR c >= 4001 END AS supports_create_or_alter,
          CASE WHEN managed THEN true WHEN ruled THEN CASE a WHEN 13 THEN c >= 5026 WHEN 14 THEN c > 3015 OR (c = 3015 AND d >= 40) ELSE true END END AS supports_maxdop,
          CASE WHEN managed THEN true WHEN ruled THEN CASE a WHEN 13 THEN c >= 5026 OR (c >= 4446 AND c < 5000) WHEN 14 THEN c > 3006 OR (c = 3006 AND d >= 16) ELSE true END END AS supports_persist,
          CASE WHEN managed THEN true WHEN ruled THEN CASE a WHEN 13 THEN c >= 6300 OR (c < 6000 AND (c > 5888 OR (c = 5888 AND d >= 11)))
            WHEN 14 THEN c > 3411 OR (c = 3411 AND d >= 3) WHEN 15 THEN c > 4123 OR (c = 4123 AND d >= 1) ELSE true END END AS supports_rebuild_keeps,
          CASE WHEN managed THEN true WHEN ruled THEN a <> 13 OR c >= 4422 END AS supports_histogram,
          CASE WHEN managed OR ruled THEN true END AS supports_query_store,
          CASE WHEN managed THEN true WHEN ruled THEN a >= 14 END AS supports_wait_stats,
          CASE WHEN managed THEN NULL WHEN ruled THEN a >= 16 END AS supports_ce_feedback
        FROM (SELECT *, engine_edition = 8 AS managed,
            coalesce(engine_edition IN (2, 3, 4) AND n = 4 AND a BETWEEN 13 AND 17 AND b = 0 AND d >= 0
              AND c >= CASE a WHEN 13 THEN 1601 WHEN 15 THEN 2000 ELSE 1000 END, false) AS ruled
          FROM (SELECT *, len(p) AS n, p[greatest(len(p) - 3, 0)] AS a, p[greatest(len(p) - 2, 0)] AS b, p[greatest(len(p) - 1, 0)] AS c, p[len(p)] AS d
            FROM (SELECT *, {VERSION_PARTS} AS p FROM versions)))"""


@query(
    "cap_matrix",
    CAP_SQL,
    ("versions",),
)
def cap_matrix(x: Inputs) -> DataFrame:
    return capability.with_capabilities(x.versions.drop("case_no"))


INVENTORY_SQL = """
inventory AS (
  SELECT database_id, c AS column_name, CASE WHEN database_id % 13 = 0 AND c = 'rows' THEN 208 END AS error_number
  FROM datasets, (VALUES ('rows'), ('rows_sampled'), ('steps'), ('modification_counter'), ('persisted_sample_percent')) v(c)
  WHERE NOT (database_id % 7 = 0 AND c = 'persisted_sample_percent') AND NOT (database_id % 11 = 0 AND c = 'rows'))"""


PROBE_SQL = """SELECT database_id, CASE WHEN e IS NOT NULL THEN 'DESCRIPTION_FAILED' WHEN NOT r THEN 'DESCRIPTION_INCOMPLETE'
         WHEN p THEN 'COLUMN_PRESENT' ELSE 'COLUMN_NOT_PRESENT' END AS probe_status,
         CASE WHEN e IS NULL AND r THEN p END AS has_persist_metadata, e AS probe_error
       FROM (SELECT database_id, max(error_number) AS e, bool_or(column_name = 'rows') AS r, bool_or(column_name = 'persisted_sample_percent') AS p
             FROM inventory GROUP BY ALL)"""


@query(
    "cap_probe",
    PROBE_SQL,
    ("datasets",),
    (INVENTORY_SQL,),
)
def cap_probe(x: Inputs) -> DataFrame:
    return cap_probe_frame(x)


def cap_probe_frame(x: Inputs) -> DataFrame:
    # fixed values: the columns of a statistics view
    names = F.array(*[F.lit(c) for c in ("rows", "rows_sampled", "steps", "modification_counter", "persisted_sample_percent")])
    columns = x.datasets.select("database_id", F.explode(names).alias("column_name"))
    gone = ((F.col("database_id") % 7 == 0) & (F.col("column_name") == "persisted_sample_percent")) | (
        (F.col("database_id") % 11 == 0) & (F.col("column_name") == "rows")
    )
    failed = F.when((F.col("database_id") % 13 == 0) & (F.col("column_name") == "rows"), F.lit(208))
    return capability.probe_metadata(columns.where(~gone).withColumn("error_number", failed))


