"""Registered queries and the DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statwarden.plans import fixtures
from statwarden.session import prepare, spread
from statwarden.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The frames of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.loaded: dict[str | tuple[str, str], DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        build = fixtures.policies(self.spark) if name == "policies" else fixtures.frame(name, self.table)
        setattr(self, name, build)
        return build

    def table(self, name: str) -> DataFrame:
        if name not in self.loaded:
            self.loaded[name] = tables.load(self.spark, self.sf_dir, name)
        return self.loaded[name]

    def spread(self, name: str) -> DataFrame:
        """A frame of statistics, one by one over all cores; the frame itself if its splits are enough for that."""
        if ("spread", name) not in self.loaded:
            self.loaded["spread", name] = spread(getattr(self, name), "stats_id")
        return self.loaded["spread", name]

    def files(self, name: str) -> DataFrame:
        """The table as it lies on disk, with its file metadata."""
        return tables.load(self.spark, self.sf_dir, name)


def query(key: str, sql: str | None = None, frames: tuple[str, ...] = (), ctes: tuple[str, ...] = ()):
    """Registers a query; ``frames`` and ``ctes`` are put before ``sql`` in a WITH."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(prepare(spark), sf_dir))

        QUERIES[key] = run
        if sql is not None:
            parts = [fixtures.cte(f) for f in frames] + list(ctes)
            ORACLES[key] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return fn

    return register
