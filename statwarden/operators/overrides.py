"""Approved overrides: which one wins for a statistic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import holds
from statwarden.operators.skew import HOT_ROWS, lookup

TABLE_KEY = ["database_name", "schema_name", "table_name"]
STAT_KEY = [*TABLE_KEY, "stat_name"]
PAYLOAD = ["override_id", "action", "sample_percent", "sample_rows", "persistence_mode", "force_update", "expires_at"]
# Bits of the set of marks that facts are held against, 64 to a row: at most a million rows
# to broadcast. More overrides make it less sharp, never larger.
MARKS = 1 << 26


def active(overrides: DataFrame, as_of: datetime) -> DataFrame:
    """Enabled overrides that have not expired at ``as_of``."""
    return overrides.where(
        F.col("is_enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))
    )


def _best(overrides: DataFrame, key: list[str], name: str) -> DataFrame:
    """One override per key: an exclusion first, then the lowest id."""
    fields = ", ".join(f"{field} AS o_{field}" for field in PAYLOAD)
    candidate = F.expr(f"struct(if(action = 'EXCLUDE', 0, 1) AS o_rank, {fields})")
    return overrides.groupBy(*key).agg(F.min(candidate).alias(name))


def _mark(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(MARKS))


def _marked(facts: DataFrame, current: DataFrame) -> DataFrame:
    """Facts with ``__marked``: false where no override can apply."""
    place = F.when(F.col("stat_name").isNull(), _mark(TABLE_KEY)).otherwise(_mark(STAT_KEY))
    bit = F.expr("shiftleft(1L, cast(__place % 64 AS int))")
    marks = current.select(place.alias("__place")).groupBy(F.shiftright("__place", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    df, hits = facts, []
    for key, name in ((STAT_KEY, "__stat"), (TABLE_KEY, "__table")):
        own = marks.select(F.col("__word").alias(f"{name}_word"), F.col("__bits").alias(f"{name}_bits"))
        df = df.join(F.broadcast(own), F.shiftright(_mark(key), 6) == F.col(f"{name}_word"), "left")
        hits.append(holds(F.getbit(F.col(f"{name}_bits"), (_mark(key) % 64).cast("int")) == 1))
    return df.select(*facts.columns, (hits[0] | hits[1]).alias("__marked"))


def with_winning_override(
    facts: DataFrame, overrides: DataFrame, as_of: datetime, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None, read_twice: bool = False
) -> DataFrame:
    """Facts with the winning override in ``o_`` columns (NULL when there is none).

    Exclusions come first, then statistic-level before table-level, then the
    lowest id. Overrides are reduced to one per key before they meet the facts;
    a table holding very many statistics is spread over many tasks; ``sizes`` may be
    a cheaper frame to find such tables in.

    Facts that are cheap to ``read_twice`` (a scan) are held against the marks of all overrides first: only
    those that an override may apply to are shuffled to meet it, the others pass as they are.
    """
    current = active(overrides, as_of)
    if read_twice:
        marked = _marked(facts, current)
        some, none = marked.where("__marked").drop("__marked"), marked.where("NOT __marked").drop("__marked")
        counted = None if sizes is None else _marked(sizes, current).where("__marked")
        return _winning(some, current, hot_rows, counted).unionByName(without_override(none, overrides))
    return _winning(facts, current, hot_rows, sizes)


def _winning(facts: DataFrame, current: DataFrame, hot_rows: int, sizes: DataFrame | None) -> DataFrame:
    per_stat = _best(current.where(F.col("stat_name").isNotNull()), STAT_KEY, "__stat")
    per_table = _best(current.where(F.col("stat_name").isNull()), TABLE_KEY, "__table")
    df = lookup(facts, per_table, TABLE_KEY, ["stat_name"], hot_rows=hot_rows, sizes=sizes).join(per_stat, STAT_KEY, "left")
    table_wins = F.col("__stat").isNull() | holds(F.col("__table.o_rank") < F.col("__stat.o_rank"))
    df = df.withColumn("__win", F.when(table_wins, F.col("__table")).otherwise(F.col("__stat")))
    return df.select("*", "__win.*").drop("__stat", "__table", "__win", "o_rank")


def without_override(facts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Facts with empty ``o_`` columns, of the types in ``overrides`` if given."""
    kinds = {name: overrides.schema[name].dataType for name in PAYLOAD} if overrides is not None else {
        "override_id": "bigint", "action": "string", "sample_percent": "decimal(9,4)", "sample_rows": "bigint",
        "persistence_mode": "string", "force_update": "boolean", "expires_at": "timestamp_ntz",
    }
    return facts.select("*", *[F.lit(None).cast(kinds[c]).alias(f"o_{c}") for c in PAYLOAD])
