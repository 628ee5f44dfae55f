"""Named queries over the parquet tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly_queries, attendance_queries, binding_queries, filling_queries, geometry_queries, matching_queries, parsing_queries, passes_queries, pieces_queries, placement_queries, report_queries, schedule_queries, stream_queries, synthesis_queries, text_queries

_MODULES = (schedule_queries, text_queries, geometry_queries, placement_queries, pieces_queries, matching_queries, parsing_queries, passes_queries, report_queries, attendance_queries, stream_queries, binding_queries, assembly_queries, synthesis_queries, filling_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
