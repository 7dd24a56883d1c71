"""Importing this module registers every checked query."""

from lumigrid.plans import catalog_queries, event_queries, flow_queries, pixel_queries  # noqa: F401
from lumigrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
