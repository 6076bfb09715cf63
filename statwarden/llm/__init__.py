"""Operators for training-data pipelines, and their registered queries."""

from statwarden.llm import curriculum, decontamination, exact_dedup, merkle, minhash_odd, quality, run_index, secrets, token_counts, token_output, toxicity, variants, warc  # noqa: F401
from statwarden.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
