"""All queries of the grid engine and their DuckDB equivalents."""

from __future__ import annotations

from catchment.plans import cell_queries, context_queries, file_queries, flow_queries, grid_queries, grouped_queries, head_queries, image_queries, map_queries, object_queries, report_queries, stored_queries, table_queries, text_queries, workspace_queries

MODULES = (grid_queries, table_queries, grouped_queries, workspace_queries, context_queries, flow_queries, object_queries, text_queries, image_queries, file_queries, report_queries, stored_queries, map_queries, head_queries, cell_queries)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
