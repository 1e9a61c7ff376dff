"""Queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import table_queries, voxel_queries

QUERIES = voxel_queries.QUERIES | table_queries.QUERIES
ORACLES: dict[str, str] = voxel_queries.ORACLES | table_queries.ORACLES
