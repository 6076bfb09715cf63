"""Queries over catalog frames: enumeration, labels, joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c
from statwarden.operators import catalog, checks
from statwarden.plans.oracle_parts import pct_cut
from statwarden.plans.registry import Inputs, query
from statwarden.sources import documents

OWNER_SQL = """
totals AS (SELECT database_id, object_id, count(*) AS current_rows, count(DISTINCT partition_number) AS partitions
  FROM partition_rows WHERE index_id IN (0, 1) GROUP BY ALL),
owner AS (SELECT t.*, s.schema_name FROM cat_tables t JOIN cat_schemas s ON s.database_id = t.database_id AND s.schema_id = t.schema_id)"""


def partition_counts(x: Inputs) -> DataFrame:
    """Rows per object, index and partition, as partition statistics give them."""
    return x.partition_rows.groupBy("database_id", "object_id", "index_id", "partition_number").agg(F.sum("row_count").cast("bigint").alias("row_count"))


@query(
    "src_partition_rowcount",
    """SELECT database_id, object_id, count(*) AS current_rows, count(DISTINCT (index_id, partition_number)) AS partition_count
       FROM partition_rows WHERE index_id IN (0, 1) GROUP BY ALL""",
    ("partition_rows",),
)
def src_partition_rowcount(x: Inputs) -> DataFrame:
    return catalog.partition_rows(partition_counts(x))


CATALOG_FRAMES = ("cat_stats", "cat_tables", "cat_schemas", "cat_indexes", "cat_columns", "partition_rows")
CATALOG_COLUMNS = [
    "database_name", "schema_name", "table_name", "stat_name", "object_id", "stats_id", "index_name", "index_type",
    "is_disabled", "base_index_type", "base_disabled", "current_rows", "leading_column", "leading_type", "auto_created", "no_recompute",
]


def enumerated(x: Inputs) -> DataFrame:
    return catalog.enumerate_statistics(x.cat_stats, x.cat_tables, x.cat_schemas, x.cat_indexes, partition_counts(x), x.cat_columns)


ENUMERATED_SQL = """
FROM cat_stats st JOIN owner o ON o.database_id = st.database_id AND o.object_id = st.object_id
  LEFT JOIN cat_indexes i ON i.database_id = st.database_id AND i.object_id = st.object_id AND i.index_id = st.stats_id
  LEFT JOIN totals r ON r.database_id = st.database_id AND r.object_id = st.object_id
  LEFT JOIN cat_columns c ON c.database_id = st.database_id AND c.object_id = st.object_id AND c.column_id = st.leading_column_id"""


@query(
    "src_statistic_catalog",
    f"""SELECT o.database_name, o.schema_name, o.table_name, st.stat_name, st.object_id, st.stats_id, i.index_name, i.index_type, i.is_disabled,
          o.base_index_type, o.base_disabled, r.current_rows, c.column_name AS leading_column, c.data_type AS leading_type, st.auto_created, st.no_recompute
        {ENUMERATED_SQL}
        WHERE (NOT o.is_ms_shipped OR o.database_id IN (1, 3, 4)) AND NOT o.is_external""",
    CATALOG_FRAMES,
    (OWNER_SQL,),
)
def src_statistic_catalog(x: Inputs) -> DataFrame:
    df = enumerated(x)
    return df.where(catalog.visible(c)).select(*CATALOG_COLUMNS)


@query(
    "join_inner_catalog",
    """SELECT o.database_id, o.schema_name, o.table_name, st.stat_name FROM cat_stats st JOIN owner o ON o.database_id = st.database_id AND o.object_id = st.object_id""",
    ("cat_stats", "cat_tables", "cat_schemas", "partition_rows"),
    (OWNER_SQL,),
)
def join_inner_catalog(x: Inputs) -> DataFrame:
    owner = catalog.owned_tables(x.cat_tables, x.cat_schemas)
    df = catalog.lookup(x.cat_stats, owner, catalog.TABLE_KEY, ["stats_id"], how="inner")
    return df.select("database_id", "schema_name", "table_name", "stat_name")


@query(
    "join_left_enrich",
    f"""SELECT st.stats_id, i.index_name, coalesce(i.is_disabled, false) AS index_disabled, coalesce(i.is_hypothetical, false) AS index_hypothetical,
          o.base_index_type, r.current_rows, c.column_name AS leading_column {ENUMERATED_SQL}""",
    CATALOG_FRAMES,
    (OWNER_SQL,),
)
def join_left_enrich(x: Inputs) -> DataFrame:
    return enumerated(x).select(
        "stats_id", "index_name",
        F.coalesce("is_disabled", F.lit(False)).alias("index_disabled"),
        F.coalesce("is_hypothetical", F.lit(False)).alias("index_hypothetical"),
        "base_index_type", "current_rows", "leading_column",
    )


# ---------------------------------------------------------------- filters and labels


@query(
    "filter_statistics_scope",
    """SELECT scope, stats_id FROM fleet CROSS JOIN (VALUES ('ALL'), ('INDEX_ONLY'), ('AUTO_ONLY'), ('USER_ONLY'), ('NON_AUTO')) v(scope)
       WHERE scope = 'ALL' OR (scope = 'INDEX_ONLY' AND index_type IS NOT NULL) OR (scope = 'AUTO_ONLY' AND index_type IS NULL AND auto_created)
         OR (scope = 'USER_ONLY' AND index_type IS NULL AND user_created) OR (scope = 'NON_AUTO' AND NOT auto_created)""",
    ("fleet",),
)
def filter_statistics_scope(x: Inputs) -> DataFrame:
    """All five scopes in one pass: each row lists the scopes it belongs to."""
    f = x.fleet
    member = F.array_compact(F.array(*[F.when(catalog.in_statistics_scope(c, s), F.lit(s)) for s in catalog.SCOPES]))
    return f.select(F.explode(member).alias("scope"), "stats_id")


@query(
    "filter_shipped_external",
    "SELECT database_id, stats_id FROM fleet WHERE (is_ms_shipped = false OR database_id IN (1, 3, 4)) AND is_external = false",
    ("fleet",),
)
def filter_shipped_external(x: Inputs) -> DataFrame:
    return x.fleet.where(catalog.visible(c)).select("database_id", "stats_id")


@query(
    "proj_index_family",
    """SELECT stats_id, index_type, CASE WHEN index_type IS NULL THEN 'STANDALONE' WHEN index_type <= 2 THEN 'ROWSTORE' WHEN index_type = 3 THEN 'XML'
         WHEN index_type = 4 THEN 'SPATIAL' WHEN index_type <= 6 THEN 'COLUMNSTORE' WHEN index_type = 7 THEN 'HASH' WHEN index_type = 9 THEN 'JSON'
         ELSE 'UNKNOWN' END AS index_family FROM fleet""",
    ("fleet",),
)
def proj_index_family(x: Inputs) -> DataFrame:
    return x.fleet.select("stats_id", "index_type", catalog.index_family(x.fleet.index_type).alias("index_family"))


@query(
    "proj_statistics_context",
    """SELECT stats_id, has_cs AS has_columnstore,
         CASE WHEN index_type IS NOT NULL THEN 'INDEX_ASSOCIATED' WHEN has_cs THEN 'STANDALONE_ON_TABLE_WITH_COLUMNSTORE' ELSE 'STANDALONE' END AS statistics_context,
         CASE base_index_type WHEN 5 THEN 'CLUSTERED_COLUMNSTORE' WHEN 1 THEN 'CLUSTERED_ROWSTORE' ELSE 'HEAP' END AS base_storage,
         CASE WHEN index_type IS NOT NULL THEN 'Index' WHEN auto_created THEN 'AutoCreated' ELSE 'UserCreated' END AS statistic_type
       FROM (SELECT *, max(coalesce(index_type IN (5, 6), false) OR base_index_type IN (5, 6)) OVER (PARTITION BY database_id, object_id) AS has_cs FROM fleet)""",
    ("fleet",),
)
def proj_statistics_context(x: Inputs) -> DataFrame:
    return catalog.statistics_context(x.fleet).select("stats_id", "has_columnstore", "statistics_context", "base_storage", "statistic_type")


@query(
    "proj_ce_context",
    """SELECT database_id, legacy AS legacy_ce, CASE legacy WHEN true THEN 'LEGACY_CE_CONTEXT' WHEN false THEN 'MODERN_CE_CONTEXT' ELSE 'AMBIGUOUS_CE_CONTEXT' END AS estimator_context
       FROM (SELECT database_id, CASE WHEN legacy_flag AND modern_flag THEN NULL WHEN modern_flag THEN false
               WHEN compat_level < 120 OR scoped_legacy OR legacy_flag THEN true ELSE false END AS legacy FROM datasets)""",
    ("datasets",),
)
def proj_ce_context(x: Inputs) -> DataFrame:
    return catalog.with_environment(x.datasets).select("database_id", "legacy_ce", "estimator_context")


@query(
    "proj_sampling_scan_behavior",
    """SELECT database_id, CASE WHEN engine_edition = 8 OR product_major >= 14 THEN 'SERIAL_SAMPLING_SCAN_OTHER_OPERATORS_MAY_PARALLELIZE'
         WHEN product_major = 13 AND compat_level = 130 THEN 'PARALLEL_SAMPLING_SCAN_POSSIBLE' ELSE 'SERIAL_SAMPLING_SCAN' END AS sampling_scan_behavior FROM datasets""",
    ("datasets",),
)
def proj_sampling_scan_behavior(x: Inputs) -> DataFrame:
    return catalog.with_environment(x.datasets).select("database_id", "sampling_scan_behavior")


EVIDENCE_SQL = """
  CASE WHEN (product_major >= 13 OR engine_edition = 8) AND compat_level >= 130 THEN 'DYNAMIC_COMPAT_130_PLUS'
       WHEN dynamic_flag THEN 'DYNAMIC_GLOBAL_TF2371' ELSE 'LEGACY_FIXED_20_PERCENT_PLUS_500' END AS threshold_context,
  CASE WHEN supports_wait_stats = false THEN 'NOT_SUPPORTED_ON_THIS_BUILD'
       WHEN query_store_state NOT IN ('READ_WRITE', 'READ_ONLY') THEN 'QUERY_STORE_NOT_ACTIVE' ELSE 'AVAILABLE_NOT_COLLECTED' END AS wait_evidence,
  CASE WHEN supports_ce_feedback = false THEN 'NOT_SUPPORTED_ON_THIS_BUILD'
       WHEN ce_feedback_setting IS NULL THEN 'SCOPED_SETTING_UNAVAILABLE_ON_THIS_POLICY'
       WHEN compat_level < 160 THEN 'COMPATIBILITY_BELOW_160' WHEN query_store_state <> 'READ_WRITE' THEN 'QUERY_STORE_NOT_READ_WRITE'
       WHEN NOT ce_feedback_setting THEN 'SCOPED_SETTING_NOT_ENABLED' ELSE 'DATABASE_PREREQUISITES_MET_NOT_COLLECTED' END AS feedback_evidence"""


@query(
    "proj_evidence_status",
    f"""SELECT database_id, {EVIDENCE_SQL},
          CASE WHEN database_id % 8 <> 0 THEN 'AVAILABLE' WHEN supports_wait_stats = false THEN 'NOT_SUPPORTED_ON_THIS_BUILD' ELSE 'UNAVAILABLE_OR_PROBE_FAILED' END AS persisted_metadata_status
        FROM datasets""",
    ("datasets",),
)
def proj_evidence_status(x: Inputs) -> DataFrame:
    e = catalog.with_environment(x.datasets)
    metadata = catalog.persisted_metadata_status(e.database_id % 8 != 0, e.supports_wait_stats)
    return e.select("database_id", "threshold_context", "wait_evidence", "feedback_evidence", metadata.alias("persisted_metadata_status"))


# ---------------------------------------------------------------- row groups and environment

HEALTH_SQL = f"""
health AS (
  SELECT database_id, object_id, index_id, partition_number, count(*) FILTER (state = 1) AS open_rowgroups, count(*) FILTER (state = 2) AS closed_rowgroups,
    CAST(coalesce(sum(total_rows) FILTER (state IN (1, 2)), 0) AS BIGINT) AS delta_rows,
    CAST(coalesce(sum(total_rows) FILTER (state = 3), 0) AS BIGINT) AS compressed_rows,
    CAST(coalesce(sum(deleted_rows) FILTER (state = 3), 0) AS BIGINT) AS compressed_deleted_rows,
    {pct_cut("coalesce(sum(total_rows) FILTER (state IN (1, 2)), 0)", "coalesce(sum(total_rows - deleted_rows) FILTER (state IN (1, 2, 3)), 0)")} AS delta_percent
  FROM row_groups GROUP BY database_id, object_id, index_id, partition_number)"""


@query("agg_partition_health", "SELECT * FROM health", ("row_groups",), (HEALTH_SQL,))
def agg_partition_health(x: Inputs) -> DataFrame:
    return catalog.partition_health(x.row_groups)


@query(
    "src_row_groups",
    """SELECT database_id, object_id, index_id, partition_number, state, count(*) AS row_groups, CAST(sum(total_rows) AS BIGINT) AS total_rows,
         CAST(sum(deleted_rows) AS BIGINT) AS deleted_rows FROM row_groups GROUP BY ALL""",
    ("row_groups",),
)
def src_row_groups(x: Inputs) -> DataFrame:
    return x.row_groups.groupBy("database_id", "object_id", "index_id", "partition_number", "state").agg(
        F.count(F.lit(1)).alias("row_groups"), F.sum("total_rows").alias("total_rows"), F.sum("deleted_rows").alias("deleted_rows")
    )


HEALTH_FIELDS = [
    "object_id", "index_id", "partition_number", "open_rowgroups", "closed_rowgroups", "delta_rows", "compressed_rows", "compressed_deleted_rows", "delta_percent",
]


def environments(x: Inputs) -> DataFrame:
    """One row per database with its labels and the health of its row-group partitions.

    The list of a database has one entry per row-group partition of its tables.
    """
    health = catalog.partition_health(x.row_groups)
    nested = health.groupBy("database_id").agg(F.sort_array(F.collect_list(F.struct(*HEALTH_FIELDS))).alias("health"))
    return catalog.with_environment(x.datasets).join(nested, "database_id", "left")


@query(
    "src_environment",
    f"""SELECT d.database_id, d.database_name, d.compat_level, d.scoped_legacy, d.writable_primary, d.auto_create_on, d.auto_update_on, d.auto_update_async,
          d.query_store_state, d.database_scoped_maxdop, d.server_maxdop, {EVIDENCE_SQL},
          h.partitions AS health_partitions, h.delta_rows AS health_delta_rows
        FROM datasets d LEFT JOIN (SELECT database_id, CAST(count(*) AS INT) AS partitions, CAST(sum(delta_rows) AS BIGINT) AS delta_rows FROM health GROUP BY 1) h
          ON h.database_id = d.database_id""",
    ("datasets", "row_groups"),
    (HEALTH_SQL,),
)
def src_environment(x: Inputs) -> DataFrame:
    delta = F.aggregate("health", F.lit(0).cast("bigint"), lambda total, part: total + part.delta_rows)
    return environments(x).select(
        "database_id", "database_name", "compat_level", "scoped_legacy", "writable_primary", "auto_create_on", "auto_update_on", "auto_update_async",
        "query_store_state", "database_scoped_maxdop", "server_maxdop", "threshold_context", "wait_evidence", "feedback_evidence",
        F.when(F.col("health").isNotNull(), F.size("health")).alias("health_partitions"), delta.alias("health_delta_rows"),
    )


@query(
    "join_outer_apply",
    """SELECT s.s_suppkey // 3 + 1 AS database_id, s.s_suppkey % 100 AS object_id, a.row_groups, a.total_rows, coalesce(a.total_rows, 0) // 1000 AS thousand_rows
       FROM supplier s LEFT JOIN LATERAL (SELECT count(*) AS row_groups, CAST(sum(total_rows) AS BIGINT) AS total_rows
         FROM row_groups r WHERE r.database_id = s.s_suppkey // 3 + 1 AND r.object_id = s.s_suppkey % 100 AND r.state = 3 HAVING count(*) > 0) a ON true""",
    ("row_groups",),
)
def join_outer_apply(x: Inputs) -> DataFrame:
    """A correlated aggregate per object: aggregate by key, then a left join."""
    per_object = x.row_groups.where("state = 3").groupBy(*catalog.TABLE_KEY).agg(
        F.count(F.lit(1)).alias("row_groups"), F.sum("total_rows").alias("total_rows")
    )
    objects = x.table("supplier").selectExpr("s_suppkey div 3 + 1 AS database_id", "s_suppkey % 100 AS object_id")
    return objects.join(per_object, catalog.TABLE_KEY, "left").withColumn(
        "thousand_rows", F.call_function("div", F.coalesce("total_rows", F.lit(0)), F.lit(1000))
    )


@query(
    "join_cross_apply",
    """SELECT p_partkey, token FROM (SELECT p_partkey, trim(unnest(string_split(listed, ','))) AS token FROM names) WHERE length(token) > 0""",
    ("names",),
)
def join_cross_apply(x: Inputs) -> DataFrame:
    tokens = F.filter(documents_tokens(F.col("listed")), lambda t: F.length(t) > 0)
    return x.names.select("p_partkey", F.explode(tokens).alias("token"))


def documents_tokens(text):
    return F.transform(F.split(text, ",", -1), lambda t: F.trim(t))


# ---------------------------------------------------------------- targets

TARGETS_SQL = """
owned AS (SELECT t.*, s.schema_name FROM cat_tables t JOIN cat_schemas s ON s.database_id = t.database_id AND s.schema_id = t.schema_id),
canonical AS (SELECT DISTINCT o.database_name, o.schema_name, o.table_name FROM target_requests q
  JOIN owned o ON lower(o.schema_name) = lower(q.schema_name) AND lower(o.table_name) = lower(q.table_name))"""
TARGET_FRAMES = ("cat_tables", "cat_schemas", "target_requests")


def canonical(x: Inputs) -> DataFrame:
    return catalog.canonical_targets(x.target_requests, catalog.owned_tables(x.cat_tables, x.cat_schemas))


@query("join_canonical_names", "SELECT * FROM canonical", TARGET_FRAMES, (TARGETS_SQL,))
def join_canonical_names(x: Inputs) -> DataFrame:
    return canonical(x)


@query(
    "join_anti",
    """SELECT DISTINCT schema_name, table_name FROM target_requests q WHERE NOT EXISTS (SELECT 1 FROM owned o
         WHERE lower(o.schema_name) = lower(q.schema_name) AND lower(o.table_name) = lower(q.table_name))""",
    TARGET_FRAMES,
    (TARGETS_SQL,),
)
def join_anti(x: Inputs) -> DataFrame:
    return catalog.missing_targets(x.target_requests, catalog.owned_tables(x.cat_tables, x.cat_schemas))


@query(
    "filter_targets",
    """SELECT f.stats_id, f.table_name FROM fleet f JOIN canonical c USING (database_name, schema_name, table_name)""",
    ("fleet", *TARGET_FRAMES),
    (TARGETS_SQL,),
)
def filter_targets(x: Inputs) -> DataFrame:
    return catalog.keep_targets(x.fleet, canonical(x)).select("stats_id", "table_name")


@query(
    "join_semi",
    """SELECT database_id, object_id FROM cat_tables t WHERE EXISTS (SELECT 1 FROM cat_indexes i WHERE i.database_id = t.database_id AND i.object_id = t.object_id AND i.index_type IN (5, 6))""",
    ("cat_tables", "cat_indexes"),
)
def join_semi(x: Inputs) -> DataFrame:
    with_columnstore = x.cat_indexes.where(F.col("index_type").isin(5, 6)).select(*catalog.TABLE_KEY)
    return x.cat_tables.join(with_columnstore, catalog.TABLE_KEY, "left_semi").select("database_id", "object_id")


@query(
    "top1_first_violation",
    """SELECT schema_name, table_name FROM target_requests q WHERE NOT EXISTS (SELECT 1 FROM owned o
         WHERE lower(o.schema_name) = lower(q.schema_name) AND lower(o.table_name) = lower(q.table_name))
       ORDER BY schema_name, table_name LIMIT 1""",
    TARGET_FRAMES,
    (TARGETS_SQL,),
)
def top1_first_violation(x: Inputs) -> DataFrame:
    return join_anti(x).orderBy("schema_name", "table_name").limit(1)


# ---------------------------------------------------------------- contracts

CONTRACT = ["database_id", "object_id", "column_id", "column_name", "data_type", "is_nullable"]
CONTRACT_SQL = """
expected AS (SELECT database_id, object_id, column_id, column_name, data_type, is_nullable FROM cat_expected WHERE wanted),
actual AS (SELECT database_id, object_id, column_id, column_name, data_type, is_nullable FROM cat_columns)"""


def contract(x: Inputs) -> tuple[DataFrame, DataFrame]:
    return x.cat_expected.where("wanted").select(*CONTRACT), x.cat_columns.select(*CONTRACT)


@query("set_except", "SELECT * FROM expected EXCEPT SELECT * FROM actual", ("cat_expected", "cat_columns"), (CONTRACT_SQL,))
def set_except(x: Inputs) -> DataFrame:
    expected, actual = contract(x)
    return expected.subtract(actual)


@query(
    "set_symmetric_diff",
    """SELECT *, 'MISSING' AS side FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)
       UNION ALL SELECT *, 'UNEXPECTED' FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)""",
    ("cat_expected", "cat_columns"),
    (CONTRACT_SQL,),
)
def set_symmetric_diff(x: Inputs) -> DataFrame:
    return checks.symmetric_difference(*contract(x))


@query(
    "check_schema_contract",
    """SELECT e.database_id || '.' || e.object_id AS table_key, e.column_name, e.column_id AS ordinal, e.data_type, a.column_id AS actual_ordinal, a.data_type AS actual_type
       FROM expected e LEFT JOIN actual a ON a.database_id = e.database_id AND a.object_id = e.object_id AND a.column_name = e.column_name
       WHERE a.object_id IS NULL OR a.data_type <> e.data_type OR a.column_id <> e.column_id""",
    ("cat_expected", "cat_columns"),
    (CONTRACT_SQL,),
)
def check_schema_contract(x: Inputs) -> DataFrame:
    sides = [
        df.select(F.concat_ws(".", "database_id", "object_id").alias("table_name"), "column_name", F.col("column_id").alias("ordinal"), "data_type") for df in contract(x)
    ]
    return checks.schema_mismatches(*sides).withColumnRenamed("table_name", "table_key")


# ---------------------------------------------------------------- inline values, generated rows, documents


@query(
    "src_inline_values",
    """SELECT v.level, v.label, count(d.database_id) AS databases FROM (VALUES (110, 'legacy'), (120, 'legacy'), (130, 'dynamic'), (140, 'dynamic'),
         (150, 'dynamic'), (160, 'feedback'), (170, 'feedback'), (180, 'none')) v(level, label) LEFT JOIN datasets d ON d.compat_level = v.level GROUP BY ALL""",
    ("datasets",),
)
def src_inline_values(x: Inputs) -> DataFrame:
    """A constant table of levels against the databases, counted before the join."""
    # fixed values: compatibility levels
    levels = x.spark.sql(
        """SELECT * FROM VALUES (110, 'legacy'), (120, 'legacy'), (130, 'dynamic'), (140, 'dynamic'),
           (150, 'dynamic'), (160, 'feedback'), (170, 'feedback'), (180, 'none') AS v(level, label)"""
    )
    per_level = x.datasets.groupBy(F.col("compat_level").alias("level")).agg(F.count(F.lit(1)).alias("databases"))
    return levels.join(per_level, "level", "left").select("level", "label", F.coalesce("databases", F.lit(0)).alias("databases"))


@query(
    "src_row_generator",
    """SELECT id, id % 1000 + CASE WHEN id <= 5000 THEN 1 ELSE 0 END AS group_key, id % 2000 + CASE WHEN id <= 5000 THEN 1 ELSE 0 END AS metric
       FROM (SELECT row_number() OVER () AS id FROM orders)""",
)
def src_row_generator(x: Inputs) -> DataFrame:
    """As many lab rows as there are orders; the first 5,000 are modified."""
    rows = catalog.generated_rows(x.table("orders").agg(F.count(F.lit(1)).alias("n")))
    modified = F.when(F.col("id") <= 5000, 1).otherwise(0)
    return rows.select("id", (F.col("id") % 1000 + modified).alias("group_key"), (F.col("id") % 2000 + modified).alias("metric"))


@query(
    "sink_document_build",
    """SELECT fleet_table_id // 500 AS part, '{"part":' || (fleet_table_id // 500) || ',"tables":[' || string_agg('{"object_id":' || fleet_table_id || ',"table_name":"' || table_name || '"'
         || CASE WHEN base_index_type IS NULL THEN '' ELSE ',"base_index_type":' || base_index_type END || '}', ',' ORDER BY fleet_table_id) || ']}' AS document
       FROM cat_tables GROUP BY 1""",
    ("cat_tables",),
)
def sink_document_build(x: Inputs) -> DataFrame:
    return table_documents(x).select("part", "document")


def table_documents(x: Inputs) -> DataFrame:
    rows = x.cat_tables.withColumn("object_id", F.col("fleet_table_id")).withColumn("part", documents.part_number(F.col("object_id")))
    listed = F.sort_array(F.collect_list(F.struct("object_id", "table_name", "base_index_type"))).alias("tables")
    return rows.groupBy("part").agg(listed).select("part", documents.document("part", "tables").alias("document"))


@query(
    "src_document_shred",
    "SELECT fleet_table_id // 500 AS part, fleet_table_id AS object_id, table_name, base_index_type FROM cat_tables",
    ("cat_tables",),
)
def src_document_shred(x: Inputs) -> DataFrame:
    schema = "part bigint, tables array<struct<object_id bigint, table_name string, base_index_type int>>"
    return documents.shred_lists(table_documents(x), schema, "tables")
