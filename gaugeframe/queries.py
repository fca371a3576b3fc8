"""Registry of the queries and their SQL."""

from __future__ import annotations

from . import queries_geometry, queries_kernels, queries_measure, queries_neighbourhood

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (queries_measure, queries_neighbourhood, queries_geometry, queries_kernels):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
