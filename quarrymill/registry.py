"""Queries over the driver's tables for every operator, and DuckDB SQL for those that SQL can express."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
