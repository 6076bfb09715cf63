"""Profiling queries over real columns of the given tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.functions.hashing import HASH_SPACE, percent_threshold, row_hash, rows_threshold
from statwarden.operators import decision, overrides, profile, sampling
from statwarden.operators.thresholds import with_native_threshold
from statwarden.plans.decisions import AS_OF_TIME, with_age

from statwarden.plans.oracle_parts import pct_cut
from statwarden.plans.registry import Inputs, query
from statwarden.session import work_folder

# fixed values: every column of the given tables, by kind of value (i whole number, d double, t text, m instant, a array)
COLUMNS = {
    "region": "i:r_regionkey t:r_name",
    "nation": "i:n_nationkey t:n_name i:n_regionkey",
    "customer": "i:c_custkey t:c_name i:c_nationkey d:c_acctbal t:c_mktsegment",
    "supplier": "i:s_suppkey t:s_name i:s_nationkey d:s_acctbal",
    "part": "i:p_partkey t:p_name t:p_brand t:p_type i:p_size d:p_retailprice",
    "orders": "i:o_orderkey i:o_custkey t:o_orderstatus d:o_totalprice m:o_orderdate t:o_orderpriority",
    "lineitem": "i:l_orderkey i:l_partkey i:l_suppkey i:l_linenumber d:l_quantity d:l_extendedprice d:l_discount d:l_tax t:l_returnflag t:l_linestatus m:l_shipdate",
    "events": "i:event_id m:ts i:user_id t:event_type d:value t:props",
    "documents": "i:doc_id t:text t:lang t:source i:n_chars",
    "embeddings": "i:vec_id a:embedding i:label",
    "pages": "i:page_id t:url t:html",
    "benchmark": "i:item_id t:text",
    "labels": "i:doc_id i:quality i:toxic",
    "conversations": "i:conv_id i:turn t:role t:text",
}
KINDS = {name: kind for listed in COLUMNS.values() for kind, name in (c.split(":") for c in listed.split())}
ALL_COLUMNS = {table: [c.split(":")[1] for c in listed.split()] for table, listed in COLUMNS.items()}
PROFILED = {table: [c for c in names if KINDS[c] != "a"] for table, names in ALL_COLUMNS.items()}
ROW_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def counts(x: Inputs, tables: Iterable[str] = ALL_COLUMNS) -> DataFrame:
    """Value counts of all columns that have an order."""
    return profile.column_counts([profile.Counted(x.table(t), t, profile.profiled(x.table(t))) for t in tables])


def steps_of(x: Inputs, counts: DataFrame) -> DataFrame:
    """The histogram of value counts; these are written once, as placing them reads them several times."""
    folder = work_folder(x.spark, "steps")
    counts.write.parquet(f"{folder}/counts")
    return profile.histogram(x.spark.read.schema(profile.COUNTS_SCHEMA).parquet(f"{folder}/counts"), folder=f"{folder}/placing")


def _value_sql(column: str) -> str:
    kind = KINDS[column]
    as_long = {"i": column, "m": f"epoch_us({column})"}.get(kind, "NULL")
    return (
        f"CAST({as_long} AS BIGINT) AS long_value, CAST({column if kind == 'd' else 'NULL'} AS DOUBLE) AS double_value, "
        f"CAST(NULL AS DECIMAL(38,18)) AS decimal_value, CAST({column if kind == 't' else 'NULL'} AS VARCHAR) AS text_value"
    )


def tall_sql(limit: str = "") -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_value_sql(c)} FROM {t}" for t, cols in PROFILED.items() for c in cols
    ]
    return " UNION ALL ".join(parts)


COUNTS_SQL = (
    f"tall AS ({tall_sql()})",
    """counts AS (SELECT table_name, column_name, long_value, double_value, decimal_value, text_value, count(*) AS value_rows
       FROM tall GROUP BY ALL)""",
)


def steps_sql(counts_name: str = "counts", steps_name: str = "steps") -> str:
    return f"""
before AS (
  SELECT *, coalesce(sum(value_rows) OVER (PARTITION BY table_name, column_name ORDER BY long_value, double_value, text_value
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before,
    sum(value_rows) OVER (PARTITION BY table_name, column_name) AS total
  FROM {counts_name} WHERE long_value IS NOT NULL OR double_value IS NOT NULL OR text_value IS NOT NULL),
cut AS (SELECT *, CAST(rows_before * 200 // total AS BIGINT) AS step FROM before),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, column_name, step ORDER BY long_value DESC, double_value DESC, text_value DESC) AS rn
  FROM cut),
{steps_name} AS (
  SELECT table_name, column_name, step,
    max(long_value) FILTER (rn = 1) AS high_long, max(double_value) FILTER (rn = 1) AS high_double, max(decimal_value) FILTER (rn = 1) AS high_decimal, max(text_value) FILTER (rn = 1) AS high_text,
    CAST(sum(value_rows) FILTER (rn = 1) AS BIGINT) AS equal_rows,
    CAST(sum(value_rows) - sum(value_rows) FILTER (rn = 1) AS BIGINT) AS range_rows,
    count(*) - 1 AS distinct_range
  FROM ranked GROUP BY table_name, column_name, step)"""


STEPS_SQL = (*COUNTS_SQL, steps_sql())
SUMMARY_SQL = (
    *STEPS_SQL,
    """summary AS (SELECT table_name, column_name, count(*) AS observed_steps,
         CAST(sum(equal_rows + range_rows) AS BIGINT) AS estimated_rows, max(equal_rows) AS max_equal_rows, max(range_rows) AS max_range_rows
       FROM steps GROUP BY ALL)""",
    """top3 AS (SELECT table_name, column_name, CAST(sum(equal_rows) AS BIGINT) AS top3_equal_rows FROM (
         SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY equal_rows DESC, step) AS place FROM steps)
       WHERE place <= 3 GROUP BY ALL)""",
)


@query("prof_value_counts", "SELECT * FROM counts", ctes=COUNTS_SQL)
def prof_value_counts(x: Inputs) -> DataFrame:
    return counts(x)


@query("prof_histogram_steps", "SELECT * FROM steps", ctes=STEPS_SQL)
def prof_histogram_steps(x: Inputs) -> DataFrame:
    return steps_of(x, counts(x))


@query(
    "src_histogram",
    "SELECT column_name, step, equal_rows, range_rows, distinct_range FROM steps WHERE table_name = 'lineitem'",
    ctes=STEPS_SQL,
)
def src_histogram(x: Inputs) -> DataFrame:
    """Histograms of one table: only its profiled columns are scanned."""
    return steps_of(x, counts(x, ["lineitem"])).select("column_name", "step", "equal_rows", "range_rows", "distinct_range")


@query("agg_histogram_summary", "SELECT * FROM summary", ctes=SUMMARY_SQL)
def agg_histogram_summary(x: Inputs) -> DataFrame:
    return profile.histogram_summary(steps_of(x, counts(x)))


@query("agg_top3_equality", "SELECT * FROM top3", ctes=SUMMARY_SQL)
def agg_top3_equality(x: Inputs) -> DataFrame:
    return profile.top_equality(steps_of(x, counts(x)))


def column_catalog(x: Inputs, tables: dict[str, list[str]]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) from the table schemas."""
    rows = []
    for table, columns in tables.items():
        schema = x.table(table).schema
        rows += [(table, c, schema.fieldNames().index(c) + 1, schema[c].dataType.simpleString()) for c in columns]
    return x.spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")


SKEW_SQL = f"""
SELECT c.table_name, c.column_name, p.available AS properties_available,
  CASE WHEN s THEN coalesce(observed_steps, 0) END AS observed_steps,
  CASE WHEN s THEN estimated_rows END AS estimated_rows, CASE WHEN s THEN max_equal_rows END AS max_equal_rows,
  CASE WHEN s THEN max_range_rows END AS max_range_rows, CASE WHEN s THEN top3_equal_rows END AS top3_equal_rows,
  CASE WHEN s THEN {pct_cut('max_equal_rows', 'estimated_rows')} END AS dominant_percent,
  CASE WHEN s THEN {pct_cut('top3_equal_rows', 'estimated_rows')} END AS top3_percent,
  CASE WHEN s IS NULL THEN 'CAPABILITY_UNKNOWN' WHEN NOT s THEN 'NOT_SUPPORTED_ON_THIS_BUILD'
       WHEN NOT p.available THEN 'STATISTICS_PROPERTIES_UNAVAILABLE' WHEN coalesce(observed_steps, 0) = 0 THEN 'NO_HISTOGRAM_ROWS'
       ELSE 'AVAILABLE' END AS histogram_status
FROM (SELECT DISTINCT table_name, column_name FROM counts UNION ALL SELECT 'embeddings', 'embedding') c
CROSS JOIN LATERAL (SELECT c.column_name <> 'lang' AS available,
  CASE c.column_name WHEN 'o_totalprice' THEN NULL WHEN 'value' THEN false ELSE true END AS s) p
LEFT JOIN summary USING (table_name, column_name) LEFT JOIN top3 USING (table_name, column_name)"""


@query("prof_skew", SKEW_SQL, ctes=SUMMARY_SQL)
def prof_skew(x: Inputs) -> DataFrame:
    """Skew per column; three columns stand for missing properties and capabilities. An array has no histogram rows."""
    catalog = column_catalog(x, ALL_COLUMNS).select(
        "table_name", "column_name", (F.col("column_name") != "lang").alias("properties_available")
    )
    supported = F.when(F.col("column_name") == "o_totalprice", F.lit(None)).otherwise(F.col("column_name") != "value")
    return profile.skew(catalog, steps_of(x, counts(x)), supported)


SAMPLED = "(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR)), 1, 8))::BIGINT)"


def _sampled_sql(limit: str) -> str:
    return f"""SELECT l_returnflag, l_linenumber, count(*) AS rows_sampled, CAST(sum(l_quantity) AS BIGINT) AS sum_quantity
        FROM lineitem WHERE {SAMPLED} < {limit} GROUP BY ALL"""


def _sampled(x: Inputs, limit) -> DataFrame:
    rows = x.table("lineitem")
    hashed = row_hash(*[F.col(c) for c in ROW_KEYS["lineitem"]])
    return _by_flag(rows.where(hashed < limit))


def _by_flag(rows: DataFrame) -> DataFrame:
    return rows.groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("rows_sampled"), F.sum("l_quantity").cast("bigint").alias("sum_quantity")
    )


@query("prof_sample_percent", _sampled_sql(f"CAST({HASH_SPACE} AS BIGINT) * 20 // 100"))
def prof_sample_percent(x: Inputs) -> DataFrame:
    return _sampled(x, percent_threshold(F.lit(20)))


@query(
    "prof_sample_rows",
    _sampled_sql(f"(SELECT least(2500, count(*)) * CAST({HASH_SPACE} AS HUGEINT) // count(*) FROM lineitem)"),
)
def prof_sample_rows(x: Inputs) -> DataFrame:
    """About 2,500 rows; the row total comes from one aggregation, kept as one value."""
    total = x.table("lineitem").agg(F.count(F.lit(1)).alias("total"))
    rows = x.table("lineitem").crossJoin(F.broadcast(total))
    hashed = row_hash(*[F.col(c) for c in ROW_KEYS["lineitem"]])
    return _by_flag(rows.where(hashed < rows_threshold(F.lit(2500).cast("bigint"), F.col("total"))))


@query("prof_fullscan", _sampled_sql(str(HASH_SPACE)))
def prof_fullscan(x: Inputs) -> DataFrame:
    return _by_flag(x.table("lineitem"))


PIECE_SQL = "strftime(l_shipdate, '%Y-%m-01')"
PIECES_SQL = (
    f"sized AS (SELECT {PIECE_SQL} AS piece, count(*) AS x FROM lineitem GROUP BY ALL)",
    "hashed AS (SELECT *, ('0x' || substr(md5(piece), 1, 8))::BIGINT AS h FROM sized)",
    f"""chosen AS (SELECT piece, x FROM hashed WHERE h < (SELECT greatest(CAST({HASH_SPACE} AS BIGINT) * 20 // 100, min(h) + 1) FROM hashed))""",
    """totals AS (SELECT (SELECT CAST(sum(x) AS BIGINT) FROM sized) AS current_rows, (SELECT count(*) FROM sized) AS pieces, count(*) AS sampled_pieces,
         CAST(sum(x) AS BIGINT) AS rows_sampled, sum(CAST(x AS HUGEINT) * x) AS xx FROM chosen)""",
    "tall AS ("
    + " UNION ALL ".join(
        f"SELECT 'lineitem' AS table_name, '{c}' AS column_name, {PIECE_SQL} AS piece, {_value_sql(c)} FROM lineitem" for c in PROFILED["lineitem"]
    )
    + ")",
    """counted AS (SELECT table_name, column_name, long_value, double_value, decimal_value, text_value, piece, count(*) AS y
         FROM tall WHERE long_value IS NOT NULL OR double_value IS NOT NULL OR text_value IS NOT NULL GROUP BY ALL)""",
    """per_value AS (SELECT table_name, column_name, long_value, double_value, decimal_value, text_value, sum(y) AS y, sum(CAST(y AS HUGEINT) * y) AS yy,
         sum(CAST(x AS HUGEINT) * y) AS xy FROM counted JOIN chosen USING (piece) GROUP BY ALL)""",
    """best AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS sampled_values,
         row_number() OVER (PARTITION BY column_name ORDER BY y DESC, long_value, double_value, text_value) AS place FROM per_value)""",
)
_SQUARES = """CAST(yy AS DOUBLE) - (CAST(y AS DOUBLE) / CAST(rows_sampled AS DOUBLE)) * 2.0::DOUBLE * CAST(xy AS DOUBLE)
  + (CAST(y AS DOUBLE) / CAST(rows_sampled AS DOUBLE)) * (CAST(y AS DOUBLE) / CAST(rows_sampled AS DOUBLE)) * CAST(xx AS DOUBLE)"""


@query(
    "prof_sample_pieces",
    f"""SELECT table_name, column_name, current_rows, pieces, sampled_pieces, rows_sampled, sampled_values, long_value, double_value, decimal_value, text_value,
          CAST(current_rows * y // rows_sampled AS BIGINT) AS dominant_rows,
          round(CASE WHEN sampled_pieces = pieces THEN 0.0::DOUBLE WHEN sampled_pieces > 1 THEN CAST(current_rows AS DOUBLE) * sqrt(greatest({_SQUARES}, 0.0::DOUBLE)
            / CAST(sampled_pieces - 1 AS DOUBLE) * (1.0::DOUBLE - CAST(sampled_pieces AS DOUBLE) / CAST(pieces AS DOUBLE)) * CAST(sampled_pieces AS DOUBLE))
            / CAST(rows_sampled AS DOUBLE) END, 3) AS dominant_error
        FROM best CROSS JOIN totals WHERE place = 1""",
    ctes=PIECES_SQL,
)
def prof_sample_pieces(x: Inputs) -> DataFrame:
    """Each column's dominant value from a fifth of the months of lineitem, which is written by month; other months are not read again."""
    folder = work_folder(x.spark, "pieces")
    month = F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd")
    rows = x.table("lineitem").withColumn("piece", month)
    rows.repartition("piece").write.partitionBy("piece").parquet(folder)
    lake = x.spark.read.parquet(folder)
    pieces = lake.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    limit = sampling.piece_limit(pieces, percent=20)
    columns = profile.profiled(x.table("lineitem"))
    return sampling.dominant_values(sampling.sampled(lake, "piece", limit), "lineitem", columns, "piece", pieces, limit)


@query(
    "src_table_rowcount",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS current_rows FROM {t}" for t in ALL_COLUMNS),
)
def src_table_rowcount(x: Inputs) -> DataFrame:
    """Rows per physical file, then per table; parquet footers answer the counts."""
    total = None
    for table in ALL_COLUMNS:
        per_file = x.files(table).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        part = per_file.agg(F.sum("rows").alias("current_rows")).select(F.lit(table).alias("table_name"), "current_rows")
        total = part if total is None else total.unionByName(part)
    return total


STATS_KEY = ["event_type", "user_id"]


def change_statistics(x: Inputs) -> DataFrame:
    """One statistic per event type and user, refreshed on a day given by the user."""
    base = F.lit("2024-01-10").cast("timestamp_ntz")
    return (
        x.changes.select(*STATS_KEY)
        .distinct()
        .withColumn("last_updated", base + F.make_dt_interval((F.col("user_id") % 10).cast("int")))
    )


MODIFICATIONS_SQL = """
SELECT event_type, user_id, TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 10 AS INT)) AS last_updated,
  count(*) FILTER (ts > TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 10 AS INT))) AS modification_counter
FROM events GROUP BY ALL"""


@query("prof_modification_counter", MODIFICATIONS_SQL)
def prof_modification_counter(x: Inputs) -> DataFrame:
    return profile.modification_counts(x.changes, change_statistics(x), STATS_KEY, "event_id")


# fixed values: approved overrides of the refresh query (column, action, percent, rows)
REFRESH_OVERRIDES = [
    ("l_returnflag", "FORCE_FULLSCAN", None, None),
    ("l_quantity", "FORCE_SAMPLE_PERCENT", 20, None),
    ("l_partkey", "FORCE_SAMPLE_ROWS", None, 2500),
    ("l_suppkey", "EXCLUDE", None, None),
    ("o_orderdate", "FORCE_SAMPLE_PERCENT", 50, None),
    ("value", "FORCE_SAMPLE_ROWS", None, 100000000),
]


def refresh_facts(x: Inputs) -> DataFrame:
    """Facts of the profiled columns: half of the rows arrived after the last refresh."""
    catalog = column_catalog(x, PROFILED)
    rows = src_table_rowcount(x)
    old = F.call_function("div", F.col("current_rows"), F.lit(2).cast("bigint"))
    false, true = F.lit(False), F.lit(True)
    return with_age(
        with_native_threshold(
            catalog.join(rows, "table_name").select(
                "table_name", "column_name", F.lit("lake").alias("database_name"), F.lit("main").alias("schema_name"),
                F.col("column_name").alias("stat_name"), "current_rows",
                old.alias("stats_rows"), old.alias("unfiltered_rows"), old.alias("rows_sampled"),
                F.when(F.col("column_name") == "source", F.lit(0).cast("bigint")).otherwise(F.col("current_rows") - old).alias("modification_counter"),
                F.lit("2024-01-01").cast("timestamp_ntz").alias("last_updated"),
                F.lit(None).cast("int").alias("index_type"),
                false.alias("has_filter"), false.alias("legacy_ce"), true.alias("writable_primary"),
                *[false.alias(c) for c in ("memory_optimized", "temporary", "base_index_disabled", "index_disabled", "hypothetical", "incremental", "no_recompute", "dynamic_flag", "auto_update_async")],
                *[true.alias(c) for c in ("properties_available", "supports_maxdop", "supports_persist", "has_persist_metadata", "rebuild_keeps", "auto_update_on")],
                F.lit(0).cast("decimal(19,6)").alias("persisted_percent"),
                F.lit(None).cast("string").alias("histogram_status"),
                F.lit(None).cast("decimal(19,6)").alias("dominant_percent"), F.lit(None).cast("decimal(19,6)").alias("top3_percent"),
                F.lit(16).alias("product_major"), F.lit(3).alias("engine_edition"), F.lit(150).alias("compat_level"),
            )
        )
    )


def refresh_plan(x: Inputs) -> DataFrame:
    """Eligible columns with their methods, through the same decision as the fleet."""
    wanted = x.spark.createDataFrame(
        [(i, c, a, p, r) for i, (c, a, p, r) in enumerate(REFRESH_OVERRIDES, 1)],
        "override_id bigint, stat_name string, action string, percent int, sample_rows bigint",
    )
    approved = refresh_facts(x).select("database_name", "schema_name", "table_name", "stat_name").join(wanted, "stat_name").select(
        "override_id", "database_name", "schema_name", "table_name", "stat_name", "action",
        F.col("percent").cast("decimal(9,4)").alias("sample_percent"), "sample_rows",
        F.lit("KEEP").alias("persistence_mode"), F.lit(False).alias("force_update"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(True).alias("is_enabled"),
    )
    policy = x.spark.sql("SELECT 1 AS policy_id, CAST(0 AS BIGINT) AS row_floor, CAST(1 AS BIGINT) AS min_modifications")
    facts = overrides.with_winning_override(refresh_facts(x), approved, AS_OF_TIME)
    decided = decision.decide(facts.crossJoin(F.broadcast(decision.complete_policy(policy))))
    return decided.where("can_execute").select(
        "table_name", "column_name", "reason", "collection_method", "requested_sample_percent", "requested_sample_rows", "current_rows"
    )


def _refresh_sql() -> str:
    actions = {c: (a, p, r) for c, a, p, r in REFRESH_OVERRIDES}
    parts, plan = [], []
    for table, columns in PROFILED.items():
        key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in ROW_KEYS[table])
        hashed = f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"
        n = f"(SELECT count(*) FROM {table})"
        for c in columns:
            action, percent, rows = actions.get(c, (None, None, None))
            if action == "EXCLUDE" or c == "source":
                continue
            limit = {
                None: str(HASH_SPACE),
                "FORCE_FULLSCAN": str(HASH_SPACE),
                "FORCE_SAMPLE_PERCENT": f"CAST({HASH_SPACE} AS BIGINT) * {percent} // 100",
                "FORCE_SAMPLE_ROWS": f"least({rows}, {n}) * CAST({HASH_SPACE} AS HUGEINT) // {n}",
            }[action]
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, {_value_sql(c)} FROM {table} WHERE {hashed} < {limit}")
            method = {None: "AUTO", "FORCE_FULLSCAN": "FULLSCAN", "FORCE_SAMPLE_PERCENT": "SAMPLE_PERCENT", "FORCE_SAMPLE_ROWS": "SAMPLE_ROWS"}[action]
            pct = 100 if action == "FORCE_FULLSCAN" else percent
            plan.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{method}' AS collection_method, "
                f"CAST({'NULL' if pct is None else pct} AS DECIMAL(19,6)) AS requested_sample_percent, "
                f"CAST({'NULL' if rows is None else f'least({rows}, {n})'} AS BIGINT) AS requested_sample_rows, {n} AS current_rows"
            )
    return f"""WITH tall AS ({' UNION ALL '.join(parts)}), {COUNTS_SQL[1]}, {steps_sql()}, {SUMMARY_SQL[-2]}, {SUMMARY_SQL[-1]},
      plan AS ({' UNION ALL '.join(plan)}),
      sampled AS (SELECT table_name, column_name, CAST(sum(value_rows) AS BIGINT) AS after_rows_sampled, count(*) AS sampled_values FROM counts GROUP BY ALL)
      SELECT p.table_name, p.column_name, 'MODIFICATION_THRESHOLD' AS reason, p.collection_method, p.requested_sample_percent, p.requested_sample_rows,
        p.current_rows, p.current_rows AS after_rows, coalesce(after_rows_sampled, 0) AS after_rows_sampled, coalesce(sampled_values, 0) AS sampled_values,
        coalesce(observed_steps, 0) AS after_steps, max_equal_rows, top3_equal_rows
      FROM plan p LEFT JOIN sampled USING (table_name, column_name) LEFT JOIN summary USING (table_name, column_name)
        LEFT JOIN top3 USING (table_name, column_name)"""


@query("prof_refresh_batch", _refresh_sql())
def prof_refresh_batch(x: Inputs) -> DataFrame:
    return profile.refresh_batch(refresh_plan(x), {t: x.table(t) for t in PROFILED}, ROW_KEYS, work_folder(x.spark, "refresh")).drop("estimated_rows")


