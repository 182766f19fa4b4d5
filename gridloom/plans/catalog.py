"""All queries over the supplied tables, by name, and their SQL equivalents."""

from __future__ import annotations

from gridloom.plans import curve_queries, detail_queries, grid_queries, library_queries, series_queries

QUERIES: dict = {**grid_queries.QUERIES, **series_queries.QUERIES, **curve_queries.QUERIES, **library_queries.QUERIES, **detail_queries.QUERIES}
ORACLES: dict[str, str] = {**grid_queries.ORACLES, **series_queries.ORACLES, **curve_queries.ORACLES, **library_queries.ORACLES, **detail_queries.ORACLES}
