"""Column profiles: value counts, equal-height histograms, skew, sampled refresh.

Values of all types share one tall shape: whole numbers, booleans, dates and
instants in ``long_value``, fractions in ``double_value``, exact decimals in
``decimal_value``, text in ``text_value``. Arrays, maps and structs have no order and no
histogram; ``profiled`` leaves them out and ``skew`` reports them with a status.
A column has values of one kind. Values are counted kind by kind, each by its own short
key, so a table is read once per kind of its columns and every column once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwarden.functions.hashing import HASH_SPACE, percent_threshold, row_hash, rows_threshold
from statwarden.functions.logic import first_match, holds
from statwarden.functions.numeric import truncated_percent
from statwarden.functions.temporal import epoch_micros
from statwarden.operators.prefix import BYTES_PER_BUCKET, ROWS_PER_BUCKET, rows_before
from statwarden.operators.skew import lookup

STEPS = 200  # fixed value: most steps in a histogram
COLUMN_KEY = ["table_name", "column_name"]
COUNTS_SCHEMA = "table_name string, column_name string, long_value bigint, double_value double, decimal_value decimal(38,18), text_value string, value_rows bigint"
VALUE = ["long_value", "double_value", "decimal_value", "text_value"]
# Decimals keep all their digits: up to 18 after the point, 20 before it.
DECIMAL = T.DecimalType(38, 18)


VALUE_TYPES = dict(zip(VALUE, ("bigint", "double", DECIMAL, "string")))


def plain_value(df: DataFrame, name: str) -> tuple[str, Column]:
    """Where a column's values go, one of ``VALUE``, and the value itself."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        place, value = "long_value", epoch_micros(column)
    elif isinstance(kind, T.DateType):
        place, value = "long_value", F.unix_date(column)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        place, value = "long_value", column
    elif isinstance(kind, T.DecimalType):
        place, value = "decimal_value", column
    elif isinstance(kind, T.FractionalType):
        place, value = "double_value", column
    elif isinstance(kind, T.StringType):
        place, value = "text_value", column
    else:
        raise TypeError(f"column {name} of type {kind.simpleString()} has no histogram")
    return place, value.cast(VALUE_TYPES[place])


def placed_value(place: str, value: Column) -> list[Column]:
    """The columns ``VALUE``, with the value in its place."""
    return [(value if v == place else F.lit(None)).cast(kind).alias(v) for v, kind in VALUE_TYPES.items()]


def typed_value(df: DataFrame, name: str) -> Column:
    return F.struct(*placed_value(*plain_value(df, name))).alias(name)


def profiled(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The columns, all by default, whose values have a histogram."""
    ordered = (T.AtomicType,)
    return [f.name for f in df.schema if (columns is None or f.name in columns) and isinstance(f.dataType, ordered) and not isinstance(f.dataType, T.BinaryType)]


def tall(df: DataFrame, table_name: str, columns: Sequence[str], keep: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per table row and column; only the named columns are scanned.

    ``keep`` gives a condition per column under which its value is kept.
    """
    values = [typed_value(df, c) for c in columns]
    if keep:
        values = [F.when(keep[c], v).alias(c) if c in keep else v for c, v in zip(columns, values)]
    rows = df.select(*values).unpivot([], list(columns), "column_name", "value")
    if keep:
        rows = rows.where(F.col("value").isNotNull())
    return rows.select(F.lit(table_name).alias("table_name"), "column_name", "value.*")


def value_counts(rows: DataFrame) -> DataFrame:
    """Exact rows per table, column and value; counted before the shuffle."""
    return rows.groupBy(*COLUMN_KEY, *VALUE).agg(F.count(F.lit(1)).alias("value_rows"))


class Counted(NamedTuple):
    """Columns of a table whose values are to be counted; ``keep`` as in ``tall``."""

    df: DataFrame
    table_name: str
    columns: Sequence[str]
    keep: Mapping[str, Column] | None = None


def column_counts(parts: Sequence[Counted]) -> DataFrame:
    """``value_counts`` of the tall rows of all parts, one aggregation per kind of value.

    The key is a column's number and its plain value: names and the places of other kinds
    come after counting, once per value and not once per row. Columns with a condition are
    unpivoted apart from those without.
    """
    names: list[tuple[str, str]] = []
    rows: dict[str, list[DataFrame]] = {}
    for part in parts:
        alike: dict[tuple[str, bool], dict[str, Column]] = {}
        for column in part.columns:
            place, value = plain_value(part.df, column)
            sampled = column in (part.keep or {})
            # a value left out is no struct, a missing value that is kept is a struct without a value
            alike.setdefault((place, sampled), {})[column] = F.when(part.keep[column], F.struct(value.alias("value"))) if sampled else value
        for (place, sampled), values in alike.items():
            start = len(names)
            names += [(part.table_name, column) for column in values]
            numbered = [value.alias(str(start + i)) for i, value in enumerate(values.values())]
            some = part.df.select(*numbered).unpivot([], [str(start + i) for i in range(len(values))], "column", "value")
            if sampled:
                some = some.where(F.col("value").isNotNull()).select("column", "value.value")
            rows.setdefault(place, []).append(some.select(F.col("column").cast("int").alias("column"), "value"))
    tables, columns = (F.array(*[F.lit(n[i]) for n in names]) for i in range(2))
    counted = [
        reduce(DataFrame.unionByName, some).groupBy("column", "value").agg(F.count(F.lit(1)).alias("value_rows")).select(
            F.get(tables, F.col("column")).alias("table_name"), F.get(columns, F.col("column")).alias("column_name"), *placed_value(place, F.col("value")), "value_rows"
        )
        for place, some in rows.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def known() -> Column:
    return reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in VALUE])


def known_values(counts: DataFrame) -> DataFrame:
    return counts.where(known())


def properties(counts: DataFrame) -> DataFrame:
    """Per column: rows, known rows, distinct values, lowest and highest value.

    Extremes of texts are found by sorting, so texts are taken apart from all other values,
    which are not sorted; what both sides found is added up per column.
    """
    has_value = known()
    extremes = [(f, v) for v in VALUE for f in (F.min, F.max)]

    def name(f, value: str) -> str:
        return f"{f.__name__}_{value.removesuffix('_value')}"

    def found(rows: DataFrame, values: Sequence[str]) -> DataFrame:
        return rows.groupBy(*COLUMN_KEY).agg(
            F.sum("value_rows").alias("stats_rows"),
            F.coalesce(F.sum(F.when(has_value, F.col("value_rows"))), F.lit(0)).alias("known_rows"),
            F.count_if(has_value).alias("distinct_values"),
            *[(f(v) if v in values else F.lit(None).cast(VALUE_TYPES[v])).alias(name(f, v)) for f, v in extremes],
        )

    texts = F.col("text_value").isNotNull()
    sides = found(counts.where(~texts), VALUE[:-1]).unionByName(found(counts.where(texts), VALUE))
    return sides.groupBy(*COLUMN_KEY).agg(
        *[F.sum(n).alias(n) for n in ("stats_rows", "known_rows", "distinct_values")], *[f(name(f, v)).alias(name(f, v)) for f, v in extremes]
    )


def histogram(
    counts: DataFrame, steps: int = STEPS, rows_per_bucket: int = ROWS_PER_BUCKET, folder: str | None = None, bytes_per_bucket: int = BYTES_PER_BUCKET
) -> DataFrame:
    """Equal-height steps from exact value counts; missing values are left out.

    A value belongs to step ``rows before it * steps div rows``, so each value with
    at least rows / steps rows ends its step and keeps its exact count. With a ``folder``
    and written counts, many texts with a common beginning are spread as well (see ``rows_before``).
    Columns of texts are placed apart from all others, which need no sort for their steps.
    """
    values = known_values(counts)
    texts = F.col("text_value").isNotNull()

    def placed_in(part: str) -> str | None:
        return None if folder is None else f"{folder}/{part}"

    options = (steps, rows_per_bucket, bytes_per_bucket)
    return _steps(values.where(~texts), VALUE[:-1], placed_in("numbers"), *options).unionByName(_steps(values.where(texts), VALUE[-1:], placed_in("texts"), *options))


def _steps(values: DataFrame, order: Sequence[str], folder: str | None, steps: int, rows_per_bucket: int, bytes_per_bucket: int) -> DataFrame:
    """Steps of columns whose values are in the places ``order``."""
    totals = values.groupBy(*COLUMN_KEY).agg(F.sum("value_rows").alias("__total"))
    placed = rows_before(values.select(*COLUMN_KEY, *order, "value_rows"), COLUMN_KEY, order, "value_rows", "__before", rows_per_bucket, folder, bytes_per_bucket)
    step = F.call_function("div", F.col("__before") * steps, F.col("__total"))
    # a step's highest value is the one with most rows before it; a number in place of a struct needs no sort
    grouped = (
        placed.join(F.broadcast(totals), COLUMN_KEY)
        .groupBy(*COLUMN_KEY, step.alias("step"))
        .agg(
            *[F.max_by(c, "__before").alias(f"__high_{c}") for c in (*order, "value_rows")],
            F.sum("value_rows").alias("__rows"), F.count(F.lit(1)).alias("__values"),
        )
    )
    return grouped.select(
        *COLUMN_KEY,
        "step",
        *[(F.col(f"__high_{v}") if v in order else F.lit(None)).cast(kind).alias(f"high_{v.removesuffix('_value')}") for v, kind in VALUE_TYPES.items()],
        F.col("__high_value_rows").alias("equal_rows"),
        (F.col("__rows") - F.col("__high_value_rows")).alias("range_rows"),
        (F.col("__values") - 1).alias("distinct_range"),
    )


def top_equality(steps: DataFrame, n: int = 3) -> DataFrame:
    """Sum of the ``n`` largest ``equal_rows`` per column; a column has few steps."""
    return steps.groupBy(*COLUMN_KEY).agg(_largest(n))


def _largest(n: int) -> Column:
    largest = F.slice(F.sort_array(F.collect_list("equal_rows"), asc=False), 1, n)
    return F.aggregate(largest, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("top3_equal_rows")


def _summary_columns() -> list[Column]:
    def whole(column):
        return F.coalesce(F.col(column), F.lit(0))

    return [
        F.count(F.lit(1)).alias("observed_steps"),
        F.sum(whole("equal_rows") + whole("range_rows")).alias("estimated_rows"),
        F.max(whole("equal_rows")).alias("max_equal_rows"),
        F.max(whole("range_rows")).alias("max_range_rows"),
    ]


def histogram_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*COLUMN_KEY).agg(*_summary_columns())


def step_summary(steps: DataFrame, n: int = 3) -> DataFrame:
    """Summary and the sum of the ``n`` largest ``equal_rows``, by one aggregation; a column has at most ``STEPS`` steps to list."""
    return steps.groupBy(*COLUMN_KEY).agg(*_summary_columns(), _largest(n))


def skew(catalog: DataFrame, steps: DataFrame, supported: Column) -> DataFrame:
    """Dominant and top-three share per catalogued column, with an analysis status.

    ``catalog`` has one row per column and ``properties_available``.
    """
    df = catalog.join(step_summary(steps), COLUMN_KEY, "left").withColumn("__supported", supported)
    status = first_match(
        [
            (F.col("__supported").isNull(), "CAPABILITY_UNKNOWN"),
            (~F.col("__supported"), "NOT_SUPPORTED_ON_THIS_BUILD"),
            (~holds(F.col("properties_available")), "STATISTICS_PROPERTIES_UNAVAILABLE"),
            (F.coalesce("observed_steps", F.lit(0)) == 0, "NO_HISTOGRAM_ROWS"),
        ],
        "AVAILABLE",
    )

    def if_supported(column, alias):
        return F.when(F.col("__supported"), column).alias(alias)

    return df.select(
        *catalog.columns,
        if_supported(F.coalesce("observed_steps", F.lit(0)), "observed_steps"),
        if_supported(F.col("estimated_rows"), "estimated_rows"),
        if_supported(F.col("max_equal_rows"), "max_equal_rows"),
        if_supported(F.col("max_range_rows"), "max_range_rows"),
        if_supported(F.col("top3_equal_rows"), "top3_equal_rows"),
        if_supported(truncated_percent(F.col("max_equal_rows"), F.col("estimated_rows")), "dominant_percent"),
        if_supported(truncated_percent(F.col("top3_equal_rows"), F.col("estimated_rows")), "top3_percent"),
        status.alias("histogram_status"),
    )


def hash_threshold(plan: DataFrame) -> Column:
    """Row-hash limit of each planned refresh; the whole hash range for a full scan.

    The default method reads every row, unless the plan has a column ``auto_sample_rows``:
    the policy's amount of rows for it, null for all.
    """
    whole = F.lit(HASH_SPACE).cast("bigint")
    auto = F.lit(None).cast("bigint")
    if "auto_sample_rows" in plan.columns:
        auto = rows_threshold(plan.auto_sample_rows, plan.current_rows)
    return F.coalesce(
        F.when(plan.collection_method == "SAMPLE_PERCENT", percent_threshold(plan.requested_sample_percent))
        .when(plan.collection_method == "SAMPLE_ROWS", rows_threshold(plan.requested_sample_rows, plan.current_rows))
        .when(plan.collection_method == "AUTO", auto),
        whole,
    )


# Tables whose plan rows are read and scanned by one job: bounds what the driver holds and the size of a plan.
TABLES_PER_JOB = 32


def refresh_batch(
    plan: DataFrame, tables: Mapping[str, DataFrame], row_keys: Mapping[str, Sequence[str]], folder: str, tables_per_job: int = TABLES_PER_JOB
) -> DataFrame:
    """Re-profiles the planned columns, each with its own method, by one job for all columns of a few tables.

    ``plan`` has one row per column (table_name, column_name, collection_method,
    requested_sample_percent, requested_sample_rows, current_rows). It is written
    to ``folder`` once. Then job by job the driver reads the plan of a few tables,
    no longer than their schemas, leaves out what is not due, and adds the
    tables' value counts to ``folder``; all that follows reads those counts.
    """
    spark = plan.sparkSession
    plan.withColumn("__limit", hash_threshold(plan)).write.parquet(f"{folder}/plan")
    limited = spark.read.parquet(f"{folder}/plan")
    plan = limited.drop("__limit")
    names = sorted(tables)
    for first in range(0, len(names), tables_per_job):
        some = names[first : first + tables_per_job]
        by_table: dict[str, dict[str, int]] = {}
        due = limited.where(F.col("table_name").isin(some)).select("table_name", "column_name", "__limit")
        for row in due.toArrow().to_pylist():
            by_table.setdefault(row["table_name"], {})[row["column_name"]] = row["__limit"]
        parts = []
        for table_name, columns in sorted(by_table.items()):
            hashed = tables[table_name].withColumn("__hash", row_hash(*[F.col(c) for c in row_keys[table_name]]))
            keep = {c: F.col("__hash") < limit for c, limit in columns.items() if limit < HASH_SPACE}
            parts.append(Counted(hashed, table_name, profiled(hashed, sorted(columns)), keep))
        if any(part.columns for part in parts):
            column_counts(parts).write.mode("append").parquet(f"{folder}/counts")
        elif first == 0:
            spark.createDataFrame([], COUNTS_SCHEMA).write.mode("append").parquet(f"{folder}/counts")
    counts = spark.read.schema(COUNTS_SCHEMA).parquet(f"{folder}/counts")
    steps = histogram(counts, folder=f"{folder}/placing")
    sampled = counts.groupBy(*COLUMN_KEY).agg(
        F.sum("value_rows").alias("rows_sampled"), F.count(F.lit(1)).alias("sampled_values")
    )
    return (
        plan.join(sampled, COLUMN_KEY, "left")
        .join(step_summary(steps), COLUMN_KEY, "left")
        .select(
            *plan.columns,
            F.col("current_rows").alias("after_rows"),
            F.coalesce("rows_sampled", F.lit(0)).alias("after_rows_sampled"),
            F.coalesce("sampled_values", F.lit(0)).alias("sampled_values"),
            F.coalesce("observed_steps", F.lit(0)).alias("after_steps"),
            "estimated_rows",
            "max_equal_rows",
            "top3_equal_rows",
        )
    )


def modification_counts(changes: DataFrame, statistics: DataFrame, keys: Sequence[str], spread_by: str, **options) -> DataFrame:
    """Changes since the last refresh, per statistic.

    ``statistics`` has one row per key with ``last_updated``; a statistic with no
    later change counts 0. A key with very many changes is spread over many tasks,
    and counts are combined before the shuffle.
    """
    keys = list(keys)
    since = lookup(changes, statistics.select(*keys, "last_updated"), keys, [spread_by], how="inner", **options)
    counted = since.where(F.col("ts") > F.col("last_updated")).groupBy(*keys).agg(F.count(F.lit(1)).alias("counted"))
    return (
        statistics.join(counted, keys, "left")
        .withColumn("modification_counter", F.coalesce("counted", F.lit(0)))
        .drop("counted")
    )
