"""What each product version and edition can do, as a batch over an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.logic import c, first_match, holds
from statwarden.functions.text import name_part

# fixed values: managed service edition, and the editions the build rules cover
MANAGED_EDITION = 8
RULED_EDITIONS = (2, 3, 4)

# fixed values: lowest supported build per major version
FIRST_BUILD = {13: 1601, 14: 1000, 15: 2000, 16: 1000, 17: 1000}

# fixed values: (major, first build, first revision, build the range ends before or None).
# A feature is on inside any of its ranges; majors above 15 have all five.
FEATURE_RANGES = {
    "create_or_alter": [(13, 4001, 0, None), (14, 0, 0, None), (15, 0, 0, None)],
    "maxdop": [(13, 5026, 0, None), (14, 3015, 40, None), (15, 0, 0, None)],
    "persist": [(13, 4446, 0, 5000), (13, 5026, 0, None), (14, 3006, 16, None), (15, 0, 0, None)],
    "rebuild_keeps": [(13, 5888, 11, 6000), (13, 6300, 0, None), (14, 3411, 3, None), (15, 4123, 1, None)],
    "histogram": [(13, 4422, 0, None), (14, 0, 0, None), (15, 0, 0, None)],
}


def _in_range(v: DataFrame, feature: str) -> Column:
    version = F.struct(c.product_build, c.product_revision)
    hit = c.product_major >= 16
    for major, build, revision, end in FEATURE_RANGES[feature]:
        inside = (c.product_major == major) & (version >= F.struct(F.lit(build), F.lit(revision)))
        if end is not None:
            inside = inside & (c.product_build < end)
        hit = hit | inside
    return hit


def with_capabilities(inventory: DataFrame) -> DataFrame:
    """Adds version parts, support status and eight capability flags.

    Unknown stays NULL: a version the rules do not cover has no flags at all.
    """
    text = F.col("product_version")
    parts = {"product_major": 4, "product_minor": 3, "product_build": 2, "product_revision": 1}
    v = inventory.select("*", *[name_part(text, n).try_cast("int").alias(c) for c, n in parts.items()])
    managed = c.engine_edition == MANAGED_EDITION
    enough = first_match([(c.product_major == major, c.product_build >= build) for major, build in FIRST_BUILD.items()])
    ruled = holds(
        c.engine_edition.isin(*RULED_EDITIONS)
        & (c.product_minor == 0)
        & enough
        & (c.product_revision >= 0)
        & (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) == 3)
    )

    def flag(rule: Column, if_managed: object = True) -> Column:
        return F.when(managed, F.lit(if_managed).cast("boolean")).when(ruled, rule)

    return v.select(
        "*",
        holds(managed | ruled).alias("supported_engine"),
        first_match(
            [(managed, "MANAGED_INSTANCE_SERVICE_CAPABILITIES"), (ruled, "DOCUMENTED_BUILD_RULES")],
            "UNRECOGNIZED_ENGINE_OR_VERSION",
        ).alias("build_rule_status"),
        *[flag(_in_range(v, feature)).alias(f"supports_{feature}") for feature in FEATURE_RANGES],
        flag(F.lit(True)).alias("supports_query_store"),
        flag(c.product_major >= 14).alias("supports_wait_stats"),
        flag(c.product_major >= 16, None).alias("supports_ce_feedback"),
    )


def probe_metadata(columns: DataFrame) -> DataFrame:
    """Per dataset: does its statistics view offer a persisted sampling rate?

    ``columns`` has (database_id, column_name, error_number); a row with an error
    number stands for a failed description.
    """
    seen = columns.groupBy("database_id").agg(
        F.max("error_number").alias("probe_error"),
        holds(F.max(F.col("column_name") == "rows")).alias("has_rows"),
        holds(F.max(F.col("column_name") == "persisted_sample_percent")).alias("has_percent"),
    )
    status = first_match(
        [
            (c.probe_error.isNotNull(), "DESCRIPTION_FAILED"),
            (~c.has_rows, "DESCRIPTION_INCOMPLETE"),
            (c.has_percent, "COLUMN_PRESENT"),
        ],
        "COLUMN_NOT_PRESENT",
    )
    return seen.select(
        "database_id",
        status.alias("probe_status"),
        F.when(c.probe_error.isNull() & c.has_rows, c.has_percent).alias("has_persist_metadata"),
        "probe_error",
    )
