"""Queries over the given tables, registered by key."""

from statwarden.plans import catalogs, control, decisions, inventory, lake, profiles, scalars, storage, streams, workflows  # noqa: F401
from statwarden.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
