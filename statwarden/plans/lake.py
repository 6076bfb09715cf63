"""Queries over a lake made of the given tables: two loads, a refresh run after each.

Events come day by day, orders and order lines month by month; the pieces of the first
load are those before a date. The first enforcing run finds no statistics and makes
them, then the second load arrives, and the facts tell how stale each one is.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import statwarden.enforce as enforcing
from statwarden.functions.hashing import HASH_SPACE
from statwarden.govern import Fleet, GovernanceRequest
from statwarden.operators import collect, profile
from statwarden.operators.collect import ColumnStates, RefreshLog
from statwarden.plans import profiles
from statwarden.plans.registry import Inputs, query
from statwarden.session import work_folder

FIRST, SECOND = datetime(2024, 1, 16), datetime(2024, 2, 1)
# fixed values: tables that grow, the column that tells when, the unit of a piece, and where the first load ends
GROWING = {"events": ("ts", "day", "2024-01-16"), "orders": ("o_orderdate", "month", "2001-01-01"), "lineitem": ("l_shipdate", "month", "2001-01-01")}
TABLES = ("customer", "events", "lineitem", "orders", "part", "supplier")
# approved overrides: statistic, action, percent, rows, persistence
OVERRIDES = [
    ("l_returnflag", "FORCE_FULLSCAN", None, None, "KEEP"), ("l_quantity", "FORCE_SAMPLE_PERCENT", 20, None, "ON"),
    ("l_partkey", "FORCE_SAMPLE_ROWS", None, 2500, "KEEP"), ("l_suppkey", "EXCLUDE", None, None, "KEEP"),
    ("user_id", "FORCE_SAMPLE_PERCENT", 50, None, "KEEP"), ("value", "FORCE_SAMPLE_ROWS", None, 100000000, "KEEP"),
]
LAKE_ID = 9


def piece(table: str):
    if table not in GROWING:
        return F.lit("all")
    column, unit, _ = GROWING[table]
    return F.date_format(F.date_trunc(unit, F.col(column)), "yyyy-MM-dd")


def loads(x: Inputs, table: str) -> tuple[DataFrame, DataFrame | None]:
    df = x.table(table)
    if table not in GROWING:
        return df, None
    column, _, end = GROWING[table]
    border = F.lit(end).cast("timestamp_ntz")
    return df.where(F.col(column) < border), df.where(F.col(column) >= border)


def control(x: Inputs) -> Fleet:
    """One database, approved for enforcement, with the library's default settings from a row of the given settings."""
    spark = x.spark
    datasets = spark.sql(
        f"""SELECT {LAKE_ID} AS database_id, 'lake' AS database_name, 'ONLINE' AS state, false AS is_distributor, false AS is_snapshot, true AS is_accessible,
          CAST(NULL AS BOOLEAN) AS is_primary, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS created_at"""
    )
    scope = spark.sql(
        """SELECT 'lake' AS configured_name, false AS is_excluded, true AS enabled, CAST(NULL AS STRING) AS exclusion_reason, CAST(NULL AS STRING) AS excluded_by,
          CAST(NULL AS TIMESTAMP_NTZ) AS excluded_at, 'owner' AS approved_by, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS approved_at, 'lake' AS notes, 1L AS revision"""
    )
    rows = [(i, "lake", "main", t, s, a, p, r, m) for i, (s, a, p, r, m) in enumerate(OVERRIDES, 1) for t in TABLES if s in profiles.ALL_COLUMNS[t]]
    approved = spark.createDataFrame(
        rows, "override_id bigint, database_name string, schema_name string, table_name string, stat_name string, action string, sample_percent int, sample_rows bigint, persistence_mode string"
    ).select(
        "*", F.lit(False).alias("force_update"), F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(True).alias("is_enabled")
    ).withColumn("sample_percent", F.col("sample_percent").cast("decimal(9,4)"))
    settings = x.settings.where("database_id = 2").withColumn("min_modification_count", F.lit(1).cast("bigint"))
    return Fleet(datasets, scope, settings, approved, approved)


def environment(x: Inputs) -> DataFrame:
    flags = {k: False for k in ("legacy_ce", "dynamic_flag", "auto_update_async")} | dict.fromkeys(
        ("auto_update_on", "writable_primary", "supports_maxdop", "supports_persist", "has_persist_metadata", "rebuild_keeps"), True
    )
    named = ", ".join(f"{str(v).lower()} AS {k}" for k, v in flags.items())
    return x.spark.sql(f"SELECT {LAKE_ID} AS database_id, 150 AS compat_level, 16 AS product_major, 3 AS engine_edition, {named}")


def empty_lake(x: Inputs, folder: str, tables: tuple[str, ...], second: bool) -> enforcing.Lake:
    """The lake after a load, in a folder that may hold what is known of the load before."""
    names = {t: (x.table(t) if second else loads(x, t)[0]) for t in tables}
    catalog = collect.lake_catalog(x.spark, names, LAKE_ID, "lake", "main", datetime(2020, 1, 1))
    return enforcing.Lake(names, profiles.ROW_KEYS, ColumnStates(x.spark, f"{folder}/states"), RefreshLog(x.spark, f"{folder}/refreshes"), catalog, environment(x))


REQUEST = GovernanceRequest("lake", mode="ENFORCE", row_floor=0)


def first_load(x: Inputs, folder: str, states_of: tuple[str, ...]) -> enforcing.Lake:
    """The lake with its first load refreshed and the second one arrived."""
    lake = empty_lake(x, folder, TABLES, second=False)
    lake.states.add({t: loads(x, t)[0] for t in states_of}, {t: piece(t) for t in states_of}, FIRST)
    enforcing.enforce(REQUEST, control(x), lake, "first", FIRST, f"{folder}/runs", lambda: FIRST)
    lake.states.add({t: loads(x, t)[1] for t in GROWING}, {t: piece(t) for t in GROWING}, SECOND)
    return empty_lake(x, folder, states_of, second=True)


# ---------------------------------------------------------------- SQL


def _border(table: str) -> str:
    if table not in GROWING:
        return "true"
    column, _, end = GROWING[table]
    return f"{column} < TIMESTAMP '{end} 00:00:00'"


def _hash(table: str) -> str:
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in profiles.ROW_KEYS[table])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"


def _limit(action, percent, rows, n: str) -> str:
    space = f"CAST({HASH_SPACE} AS HUGEINT)"
    return {"FORCE_SAMPLE_PERCENT": f"{space} * {percent} // 100", "FORCE_SAMPLE_ROWS": f"least({rows}, {n}) * {space} // {n}"}.get(action, space)


def _lake_sql() -> tuple[str, ...]:
    """Per column of the lake's tables: what the first run left, rows moved since, and what a second run samples."""
    wanted = {s: (a, p, r) for s, a, p, r, _ in OVERRIDES}
    values, columns = [], []
    for t in TABLES:
        n1, n2 = f"(SELECT count(*) FROM {t} WHERE {_border(t)})", f"(SELECT count(*) FROM {t})"
        for column in profiles.PROFILED[t]:
            action, percent, rows = wanted.get(column, (None, None, None))
            limits = [_limit(action, percent, rows, n) for n in (n1, n2)]
            if action != "EXCLUDE":
                values.append(f"SELECT '{t}' AS table_name, '{column}' AS column_name, {profiles._value_sql(column)} FROM {t} WHERE {_border(t)} AND {_hash(t)} < {limits[0]}")
            method = {"FORCE_FULLSCAN": "FULLSCAN", "FORCE_SAMPLE_PERCENT": "SAMPLE_PERCENT", "FORCE_SAMPLE_ROWS": "SAMPLE_ROWS"}.get(action, "AUTO")
            columns.append(
                f"SELECT '{t}' AS table_name, '{column}' AS column_name, '{action}' AS action, '{method}' AS method, {n1} AS n1, {n2} AS n2, "
                f"(SELECT count(*) FROM {t} WHERE {_hash(t)} < {limits[1]}) AS sampled2, CAST({20 if column == 'l_quantity' else 0} AS DECIMAL(19,6)) AS persisted"
            )
    return (
        f"lake_tall AS ({' UNION ALL '.join(values)})",
        """lake_counts AS (SELECT table_name, column_name, long_value, double_value, decimal_value, text_value, count(*) AS value_rows FROM lake_tall GROUP BY ALL)""",
        profiles.steps_sql("lake_counts", "lake_steps"),
        f"lake_columns AS ({' UNION ALL '.join(columns)})",
        """first_run AS (
          SELECT c.*, action <> 'EXCLUDE' AS done, s.rows_sampled, t.steps FROM lake_columns c
          LEFT JOIN (SELECT table_name, column_name, CAST(sum(value_rows) AS BIGINT) AS rows_sampled FROM lake_counts GROUP BY ALL) s USING (table_name, column_name)
          LEFT JOIN (SELECT table_name, column_name, count(*) AS steps FROM lake_steps GROUP BY ALL) t USING (table_name, column_name))""",
    )


@query(
    "enforce_lake",
    """SELECT table_name, column_name, CASE WHEN done THEN n1 END AS stats_rows, CASE WHEN done THEN coalesce(rows_sampled, 0) END AS rows_sampled,
         CASE WHEN done THEN n2 - n1 ELSE n2 END AS modification_counter, CASE WHEN done THEN coalesce(steps, 0) END AS steps, CASE WHEN done THEN persisted ELSE 0 END AS persisted_percent,
         n2 AS current_rows, reason,
         CASE WHEN reason = 'MODIFICATION_THRESHOLD' THEN 'SUCCEEDED' ELSE 'DEFERRED' END AS execution_status,
         CASE WHEN reason = 'MODIFICATION_THRESHOLD' THEN 'METADATA_COLLECTED' END AS postcheck_status,
         CASE WHEN reason = 'MODIFICATION_THRESHOLD' THEN method END AS collection_method,
         CASE WHEN reason = 'MODIFICATION_THRESHOLD' THEN n2 END AS after_rows, CASE WHEN reason = 'MODIFICATION_THRESHOLD' THEN sampled2 END AS after_rows_sampled,
         CASE WHEN reason = 'MODIFICATION_THRESHOLD' THEN persisted END AS after_persisted
       FROM (SELECT *, CASE WHEN NOT done THEN 'EXPLICIT_EXCLUSION' WHEN n2 - n1 < 1 THEN 'BELOW_MIN_MODIFICATIONS'
           WHEN (n2 - n1) * 100 >= n1 * 12 THEN 'MODIFICATION_THRESHOLD' ELSE 'BELOW_MODIFICATION_THRESHOLD' END AS reason FROM first_run)""",
    ctes=_lake_sql(),
)
def enforce_lake(x: Inputs) -> DataFrame:
    """The second enforcing run: what it found, decided, did and found afterwards."""
    folder = work_folder(x.spark, "lake")
    lake = first_load(x, folder, TABLES)
    run = enforcing.enforce(REQUEST, control(x), lake, "second", SECOND, f"{folder}/runs", lambda: SECOND)
    after = lake.refreshes.entries().where(F.col("last_updated") == F.lit(SECOND).cast("timestamp_ntz")).select(
        "table_name", "column_name", F.col("stats_rows").alias("after_rows"), F.col("rows_sampled").alias("after_rows_sampled"), F.col("persisted_percent").alias("after_persisted")
    )
    return run.telemetry.join(after, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", "stats_rows", "rows_sampled", "modification_counter", "steps", "persisted_percent", "current_rows", "reason",
        "execution_status", "postcheck_status", "collection_method", "after_rows", "after_rows_sampled", "after_persisted",
    )


@query(
    "src_stat_properties",
    f"""SELECT p.*, CASE WHEN done THEN n1 END AS unfiltered_rows, CASE WHEN done THEN coalesce(rows_sampled, 0) END AS rows_sampled, CASE WHEN done THEN TIMESTAMP '{FIRST}' END AS last_updated,
         CASE WHEN done THEN coalesce(steps, 0) END AS steps, coalesce(CASE WHEN done THEN n2 - n1 ELSE n2 END, stats_rows) AS modification_counter,
         coalesce(CASE WHEN done THEN persisted END, 0) AS persisted_percent
       FROM (SELECT table_name, column_name, CAST(sum(value_rows) AS BIGINT) AS stats_rows,
         CAST(coalesce(sum(value_rows) FILTER (k), 0) AS BIGINT) AS known_rows, count(*) FILTER (k) AS distinct_values,
         min(long_value) AS min_long, max(long_value) AS max_long, min(double_value) AS min_double, max(double_value) AS max_double,
         min(decimal_value) AS min_decimal, max(decimal_value) AS max_decimal, min(text_value) AS min_text, max(text_value) AS max_text
       FROM (SELECT *, coalesce(CAST(long_value AS VARCHAR), CAST(double_value AS VARCHAR), text_value) IS NOT NULL AS k FROM counts)
       GROUP BY ALL) p LEFT JOIN first_run USING (table_name, column_name)""",
    ctes=(*profiles.COUNTS_SQL, *_lake_sql()),
)
def src_stat_properties(x: Inputs) -> DataFrame:
    """Present values of every column, with what the lake's states and refresh log know of its statistic."""
    lake = first_load(x, work_folder(x.spark, "lake"), tuple(profiles.ALL_COLUMNS))
    known = lake.facts().select("table_name", "column_name", "unfiltered_rows", "rows_sampled", "last_updated", "steps", "modification_counter", "persisted_percent")
    return profile.properties(profiles.counts(x)).join(known, ["table_name", "column_name"], "left")
