"""Scalar function families over real columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.functions import temporal, text
from statwarden.functions.numeric import dec, percent_of_rows_ceiling, rounded_percent, truncated_percent
from statwarden.plans.fixtures import AS_OF
from statwarden.plans.oracle_parts import pct_cut, pct_round
from statwarden.plans.registry import Inputs, query


@query(
    "fn_string",
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, upper(p_type) AS uppered, length(rtrim(p_name || '   ')) AS length_no_blanks,
         left(p_brand, 3) AS first_three, right(p_brand, 2) AS last_two, substring(p_name, 2, 4) AS middle, position('a' IN p_name) AS first_a,
         replace(p_type, 'A', 'aa') AS replaced, p_brand || chr(9) || p_type AS joined, p_type LIKE '%BRASS' AS is_brass, strlen(p_name) AS bytes,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END || '!' AS null_propagates
       FROM part""",
)
def fn_string(x: Inputs) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return x.table("part").select(
        "p_partkey",
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.upper(kind).alias("uppered"),
        text.length_without_trailing_blanks(F.concat(name, F.lit("   "))).alias("length_no_blanks"),
        F.left(brand, F.lit(3)).alias("first_three"),
        F.right(brand, F.lit(2)).alias("last_two"),
        F.substring(name, 2, 4).alias("middle"),
        F.locate("a", name).alias("first_a"),
        F.replace(kind, F.lit("A"), F.lit("aa")).alias("replaced"),
        F.concat(brand, F.char(F.lit(9)), kind).alias("joined"),
        kind.like("%BRASS").alias("is_brass"),
        F.octet_length(name).alias("bytes"),
        F.concat(F.when(F.col("p_partkey") % 9 != 0, brand), F.lit("!")).alias("null_propagates"),
    )


@query(
    "fn_quotename",
    "SELECT p_partkey, CASE WHEN length(raw_name) <= 128 THEN '[' || replace(raw_name, ']', ']]') || ']' END AS quoted FROM names",
    ("names",),
)
def fn_quotename(x: Inputs) -> DataFrame:
    return x.names.select("p_partkey", text.quote_name(F.col("raw_name")).alias("quoted"))


_PARTS = r"regexp_extract_all(dotted || '.', '(\[(?:[^\]]|\]\])*\]|[^.\[]*)\.', 1)"


def _part_sql(n: int) -> str:
    part = f"p[len(p) - {n - 1}]"
    bare = f"CASE WHEN {part} LIKE '[%]' THEN replace({part}[2:-2], ']]', ']') ELSE {part} END"
    return f"CASE WHEN len(p) <= 4 AND len(p) >= {n} AND length({bare}) BETWEEN 1 AND 128 THEN {bare} END AS part_{n}"


@query(
    "fn_parsename",
    f"SELECT p_partkey, dotted, {', '.join(_part_sql(n) for n in (1, 2, 3, 4))} FROM (SELECT p_partkey, dotted, {_PARTS} AS p FROM names)",
    ("names",),
)
def fn_parsename(x: Inputs) -> DataFrame:
    return x.names.select("p_partkey", "dotted", *[text.name_part(F.col("dotted"), n).alias(f"part_{n}") for n in (1, 2, 3, 4)])


@query(
    "fn_list_parse",
    """SELECT p_partkey, unnest(list_transform(string_split(listed, ','), lambda t: trim(t))) AS token,
         len(list_filter(string_split(listed, ','), lambda t: length(trim(t)) = 0)) > 0 AS has_empty FROM names""",
    ("names",),
)
def fn_list_parse(x: Inputs) -> DataFrame:
    listed = F.col("listed")
    return x.names.select("p_partkey", F.explode(text.list_tokens(listed)).alias("token"), text.has_empty_token(listed).alias("has_empty"))


@query(
    "fn_try_convert",
    """SELECT c_custkey, try_cast(right(c_name, 9) AS INT) AS from_digits, try_cast(c_name AS INT) AS from_text,
         try_cast(CAST(c_custkey AS VARCHAR) || '99999999' AS INT) AS overflow, try_cast(substr(c_name, 10, 1 + c_custkey % 10) AS BIGINT) AS as_long FROM customer""",
)
def fn_try_convert(x: Inputs) -> DataFrame:
    name, key = F.col("c_name"), F.col("c_custkey")
    return x.table("customer").select(
        "c_custkey",
        F.right(name, F.lit(9)).try_cast("int").alias("from_digits"),
        name.try_cast("int").alias("from_text"),
        F.concat(key.cast("string"), F.lit("99999999")).try_cast("int").alias("overflow"),
        F.substr(name, F.lit(10), (key % 10 + 1).cast("int")).try_cast("bigint").alias("as_long"),
    )


@query(
    "fn_null_logic",
    """SELECT stats_id, coalesce(unfiltered_rows, stats_rows, -1) AS basis, nullif(stats_rows, 0) AS nonzero_rows, index_type IN (1, 2) AS in_rowstore,
         index_type NOT IN (5, 6) AS not_columnstore, modification_counter BETWEEN 500 AND 100000 AS between_limits,
         CASE WHEN stats_rows > 0 THEN modification_counter // stats_rows END AS whole_ratio, index_type IN (1, NULL) AS in_with_null FROM fleet""",
    ("fleet",),
)
def fn_null_logic(x: Inputs) -> DataFrame:
    rows, changes, kind = F.col("stats_rows"), F.col("modification_counter"), F.col("index_type")
    return x.fleet.select(
        "stats_id",
        F.coalesce("unfiltered_rows", rows, F.lit(-1)).alias("basis"),
        F.nullif(rows, F.lit(0)).alias("nonzero_rows"),
        kind.isin(1, 2).alias("in_rowstore"),
        (~kind.isin(5, 6)).alias("not_columnstore"),
        changes.between(500, 100000).alias("between_limits"),
        F.call_function("div", changes, F.nullif(rows, F.lit(0))).alias("whole_ratio"),
        kind.isin(1, None).alias("in_with_null"),
    )


@query(
    "fn_math",
    """SELECT stats_id, abs(current_rows - stats_rows) AS distance, CAST(ceil(stats_rows * 0.1::DOUBLE) AS BIGINT) AS rounded_up, CAST(floor(sqrt(1000.0::DOUBLE * stats_rows)) AS BIGINT) AS root,
         CASE WHEN current_rows <= stats_rows THEN current_rows ELSE stats_rows END AS smaller FROM fleet""",
    ("fleet",),
)
def fn_math(x: Inputs) -> DataFrame:
    rows, now = F.col("stats_rows"), F.col("current_rows")
    return x.fleet.select(
        "stats_id",
        F.abs(now - rows).alias("distance"),
        F.ceil(rows * F.lit(0.1)).alias("rounded_up"),
        F.floor(F.sqrt(F.lit(1000.0) * rows)).alias("root"),
        # not least(): a missing first value must give the second one
        F.when(now <= rows, now).otherwise(rows).alias("smaller"),
    )


@query(
    "fn_decimal_convert",
    f"""SELECT stats_id, {pct_round('modification_counter', 'stats_rows', 28)} AS rounded, {pct_cut('modification_counter', 'stats_rows')} AS truncated,
          CAST((CAST(stats_rows AS HUGEINT) * 125000 + 999999) // 1000000 AS BIGINT) AS share,
          CAST(CAST((2 * (k * 10000 + 5) + 10) // 20 AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(19,3)) AS half_up FROM fleet""",
    ("fleet",),
)
def fn_decimal_convert(x: Inputs) -> DataFrame:
    rows, changes = F.col("stats_rows"), F.col("modification_counter")
    with_half = dec(F.col("k"), 18, 0) + F.lit(Decimal("0.0005"))
    return x.fleet.select(
        "stats_id",
        rounded_percent(changes, rows, 28).alias("rounded"),
        truncated_percent(changes, rows).alias("truncated"),
        percent_of_rows_ceiling(rows, F.lit(Decimal("12.5"))).alias("share"),
        dec(with_half, 19, 3).alias("half_up"),
    )


@query(
    "fn_datediff_minute",
    f"""SELECT event_id, date_diff('minute', ts, TIMESTAMP '{AS_OF}') AS minutes, date_diff('millisecond', ts, TIMESTAMP '{AS_OF}') AS millis FROM events""",
)
def fn_datediff_minute(x: Inputs) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp_ntz")
    return x.table("events").select(
        "event_id",
        temporal.minute_boundaries(F.col("ts"), now).alias("minutes"),
        temporal.elapsed_millis(F.col("ts"), now).alias("millis"),
    )


@query(
    "fn_dateadd",
    """SELECT event_id, ts + to_minutes(CAST(user_id % 300 AS INT)) AS deadline, ts + to_hours(CAST(user_id % 24 AS INT)) AS expiry,
         ts + to_hours(CAST(user_id % 24 AS INT)) > TIMESTAMP '2024-01-15 12:00:00' AS still_valid FROM events""",
)
def fn_dateadd(x: Inputs) -> DataFrame:
    ts, user = F.col("ts"), F.col("user_id")
    expiry = temporal.add_hours(ts, user % 24)
    return x.table("events").select(
        "event_id",
        temporal.add_minutes(ts, user % 300).alias("deadline"),
        expiry.alias("expiry"),
        (expiry > F.lit(AS_OF).cast("timestamp_ntz")).alias("still_valid"),
    )


@query(
    "fn_hex_hash",
    "SELECT doc_id, sha256(text) AS text_hash, lower(to_hex(n_chars)) AS hex_length, '0x' || lower(lpad(to_hex(doc_id), 16, '0')) AS revision FROM documents",
)
def fn_hex_hash(x: Inputs) -> DataFrame:
    """Hash of whole texts and the hexadecimal form of row revisions."""
    return x.table("documents").select(
        "doc_id",
        F.sha2("text", 256).alias("text_hash"),
        F.lower(F.hex("n_chars")).alias("hex_length"),
        F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("doc_id"), 16, "0"))).alias("revision"),
    )


@query(
    "fn_document",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.k') AS has_k, json_extract_string(props, '$.missing') AS missing,
         CASE WHEN json_exists(props, '$.k') THEN 1 ELSE 0 END AS fields FROM events""",
)
def fn_document(x: Inputs) -> DataFrame:
    """Typed access to a document: an absent field is NULL."""
    parsed = x.table("events").withColumn("doc", F.from_json("props", "k int, missing string")).withColumn(
        "fields", F.size(F.json_object_keys("props"))
    )
    return parsed.select("event_id", "doc.k", F.col("doc.k").isNotNull().alias("has_k"), "doc.missing", "fields")
