"""Statistics from a sample of whole pieces, scaled up, with their errors.

A piece is a unit that a scan can leave out: a partition folder or a file. Pieces are
chosen by the hash of their name, so a scan with a filter on the partition column, or on
the file's name in ``_metadata``, lists and reads the chosen ones only. The rows of
every piece are known beforehand (``collect.ColumnStates`` keeps them), so a sample is
scaled by rows and not by pieces, and its error follows from how the pieces differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwarden.functions.hashing import percent_threshold, row_hash, rows_threshold
from statwarden.operators.profile import COLUMN_KEY, VALUE, known, typed_value

WIDE = "decimal(38,0)"


def piece_limit(pieces: DataFrame, percent: float | None = None, rows: int | None = None) -> int:
    """Pieces (piece, rows) whose hash lies below it hold about that share or number of rows.

    The piece of the lowest hash is always among them; 0 where there are no pieces.
    """
    if (percent is None) == (rows is None):
        raise ValueError("either percent or rows")
    wanted = percent_threshold(F.lit(percent)) if rows is None else rows_threshold(F.lit(rows).cast("bigint"), F.sum("rows"))
    lowest = F.min(row_hash(_name("piece"))) + 1
    return pieces.agg(F.coalesce(F.greatest(wanted, lowest), F.lit(0))).first()[0]


def _name(piece: str) -> Column:
    """A null piece goes by the empty name."""
    return F.coalesce(F.col(piece).cast("string"), F.lit(""))


def sampled(df: DataFrame, piece: str, limit: int) -> DataFrame:
    """Rows of the chosen pieces; no other piece is read where ``piece`` is a partition column."""
    return df.where(row_hash(_name(piece)) < limit)


def dominant_values(sample: DataFrame, table_name: str, columns: Sequence[str], piece: str, pieces: DataFrame, limit: int) -> DataFrame:
    """Per column the value with most rows in the sample, its rows in the whole table, and the standard error.

    The estimate is rows of the table times the value's share of the sampled rows; the
    error is that of a ratio over whole pieces, 0 when all pieces were read and null for a
    single one. Of values with as many rows the lowest is taken. A column without a known
    value has nulls. ``piece`` is a column of the sample, ``pieces`` has (piece, rows) of all.
    """
    values = _tall(sample, table_name, columns, piece)
    counts = values.groupBy(*COLUMN_KEY, *VALUE, "piece").agg(F.count(F.lit(1)).cast(WIDE).alias("y"))
    sizes = pieces.select(_name("piece").alias("piece"), F.col("rows").cast(WIDE).alias("x"))
    chosen = row_hash(F.col("piece")) < limit
    totals = sizes.agg(
        F.sum("x").alias("current_rows"), F.count(F.lit(1)).alias("pieces"), F.count_if(chosen).alias("sampled_pieces"),
        F.coalesce(F.sum(F.when(chosen, F.col("x"))), F.lit(0).cast(WIDE)).alias("rows_sampled"),
        F.sum(F.when(chosen, (F.col("x") * F.col("x")).cast(WIDE))).alias("xx"),
    )
    # pieces without the value add nothing to these sums
    per_value = counts.join(sizes, "piece").groupBy(*COLUMN_KEY, *VALUE).agg(
        F.sum("y").alias("y"), F.sum((F.col("y") * F.col("y")).cast(WIDE)).alias("yy"), F.sum((F.col("x") * F.col("y")).cast(WIDE)).alias("xy")
    )
    largest = F.when(known(), F.struct("y", "yy", "xy", *VALUE))
    # the highest count, then the lowest value: the one of the lowest (-count, value)
    rank = F.when(known(), F.struct((-F.col("y")).alias("less"), *VALUE))
    best = per_value.groupBy(*COLUMN_KEY).agg(F.min_by(largest, rank).alias("best"), F.count_if(known()).alias("sampled_values"))
    df = best.crossJoin(F.broadcast(totals))  # one row
    y, yy, xy = (F.col(f"best.{name}") for name in ("y", "yy", "xy"))
    x, xx, n, all_pieces = F.col("rows_sampled"), F.col("xx"), F.col("sampled_pieces"), F.col("pieces")
    share = y.cast("double") / x.cast("double")
    squares = yy.cast("double") - share * 2.0 * xy.cast("double") + share * share * xx.cast("double")
    spread = F.sqrt(F.greatest(squares, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)).cast("double") * (1.0 - n.cast("double") / all_pieces.cast("double")) * n.cast("double"))
    error = F.when(n == all_pieces, F.lit(0.0)).when(n > 1, F.col("current_rows").cast("double") * spread / x.cast("double"))
    return df.select(
        *COLUMN_KEY, F.col("current_rows").cast("bigint").alias("current_rows"), "pieces", "sampled_pieces",
        F.col("rows_sampled").cast("bigint").alias("rows_sampled"), "sampled_values", *[F.col(f"best.{v}").alias(v) for v in VALUE],
        F.call_function("div", F.col("current_rows") * y, x).cast("bigint").alias("dominant_rows"),
        F.when(y.isNotNull(), F.round(error, 3)).alias("dominant_error"),
    )


def _tall(df: DataFrame, table_name: str, columns: Sequence[str], piece: str) -> DataFrame:
    """One row per row and column, with the row's piece."""
    rows = df.select(_name(piece).alias("piece"), *[typed_value(df, c) for c in columns]).unpivot(["piece"], list(columns), "column_name", "value")
    return rows.select(F.lit(table_name).alias("table_name"), "column_name", "piece", "value.*")
