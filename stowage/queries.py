"""Registered archive queries and their SQL."""

from stowage.plans import catalog_queries, file_queries, inventory_queries, kernel_queries, rollup_queries, selection_queries  # noqa: F401
from stowage.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
