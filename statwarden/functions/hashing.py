"""Hash sampling: the same rows are chosen in every run and after every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32


def row_hash(*keys: Column) -> Column:
    """A number in [0, 2**32) from the first eight hex digits of an MD5."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def percent_threshold(percent: Column) -> Column:
    """Rows whose hash lies below this number form a sample of ``percent`` %."""
    return F.floor(percent.cast("decimal(19,6)") * F.lit(HASH_SPACE).cast("decimal(10,0)") / F.lit(100)).cast("bigint")


def rows_threshold(rows: Column, total: Column) -> Column:
    """Threshold for a sample of about ``rows`` out of ``total`` rows."""
    share = F.least(rows, total).cast("decimal(19,0)") * F.lit(HASH_SPACE).cast("decimal(10,0)")
    return F.call_function("div", share, F.when(total != 0, total).cast("decimal(19,0)")).cast("bigint")
