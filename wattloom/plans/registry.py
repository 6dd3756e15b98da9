"""Registered queries of the energy operators and their SQL."""

from __future__ import annotations

from wattloom.plans import io_queries, model_queries, more_queries, series_queries, usage_queries

_MODULES = (usage_queries, series_queries, model_queries, more_queries, io_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = "d3_extrapolate_week"
