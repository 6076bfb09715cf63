"""Three-valued logic: a condition that is unknown does not hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def fails(condition: Column) -> Column:
    return ~holds(condition)


def first_match(branches: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """Value of the first branch whose condition holds."""
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def settle(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that are worked out here and nowhere else.

    The optimizer copies the long expression behind a plain column into every
    filter on it, until the generated code is too big to compile. It does not look
    through the elements of an array, so a one-element array keeps the columns in place,
    while filters on the other columns pass it on their way to the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


class Fields:
    """Columns by attribute: ``c.stats_rows`` is ``col("stats_rows")``.

    Unlike attributes of a DataFrame these need no look at its schema, which keeps
    the building of wide plans fast.
    """

    def __getattr__(self, name: str) -> Column:
        column = F.col(name)
        if not name.startswith("_"):
            setattr(self, name, column)
        return column


c = Fields()


# A set of expressions names its inputs, so one set serves every frame. Building it
# once saves thousands of calls into the JVM per query.
expressions = cache
