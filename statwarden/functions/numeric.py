"""Exact decimal arithmetic with the rounding of the original results."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(column: Column, precision: int, scale: int) -> Column:
    return column.cast(f"decimal({precision},{scale})")


def _nonzero(column: Column) -> Column:
    return F.when(column != 0, column)


def truncated_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole cut (not rounded) after six decimals; NULL when whole is 0.

    Both inputs are whole numbers. A quotient of two wide decimals keeps six
    decimals and drops the rest, so integer division gives the same digits.
    """
    scaled = F.call_function("div", dec(part, 28, 0) * F.lit(Decimal(100_000_000)), dec(_nonzero(whole), 28, 0))
    return dec(dec(scaled, 19, 0) * F.lit(Decimal("0.000001")), 19, 6)


def rounded_percent(part: Column, whole: Column, precision: int) -> Column:
    """100 * part / whole rounded half up to six decimals; NULL unless whole > 0."""
    whole = F.when(whole > 0, whole)
    return dec(dec(part, 28, 6) / whole * F.lit(Decimal("100.0")), precision, 6)


def percent_of_rows_ceiling(rows: Column, percent: Column) -> Column:
    """CEILING(rows * percent / 100) as a long; NULL when it does not fit."""
    exact = dec(rows, 19, 0) * dec(percent, 9, 4) * F.lit(Decimal("0.01"))
    return F.ceil(exact).try_cast("bigint")
