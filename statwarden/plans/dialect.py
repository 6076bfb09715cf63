"""The few spellings that differ between Spark SQL and DuckDB.

The derived input frames are written once as SQL expressions and used by both
engines; the operators themselves are never written this way.
"""

from __future__ import annotations


class Spark:
    @staticmethod
    def div(a, b):
        return f"(({a}) div ({b}))"

    @staticmethod
    def pick(values, index):
        return f"array({', '.join(values)})[CAST({index} AS INT)]"

    @staticmethod
    def ts(text):
        return f"TIMESTAMP_NTZ'{text}'"

    @staticmethod
    def minus_seconds(ts, seconds):
        return f"({ts} - make_dt_interval(0, 0, 0, {seconds}))"

    @staticmethod
    def plus_days(ts, days):
        return f"({ts} + make_dt_interval(CAST({days} AS INT)))"

    @staticmethod
    def explode_range(n):
        return f"explode(sequence(0, {n} - 1))"


class Duck:
    @staticmethod
    def div(a, b):
        return f"(({a}) // ({b}))"

    @staticmethod
    def pick(values, index):
        return f"([{', '.join(values)}])[CAST({index} AS INT) + 1]"

    @staticmethod
    def ts(text):
        return f"TIMESTAMP '{text}'"

    @staticmethod
    def minus_seconds(ts, seconds):
        return f"({ts} - to_seconds({seconds}))"

    @staticmethod
    def plus_days(ts, days):
        return f"({ts} + to_days(CAST({days} AS INT)))"

    @staticmethod
    def explode_range(n):
        return f"CAST(unnest(range(0, {n})) AS INT)"
