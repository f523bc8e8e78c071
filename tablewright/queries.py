"""All queries of the engine by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import anchors, eav, extraction, fields, geometry, label_search, linkage, matching, page_folds, page_sources, region_tables, reports, scalars, templates
from .plans import bank, typed_export, usage, utility

MODULES = (utility, bank, eav, usage, scalars, linkage, matching, geometry, page_folds, extraction, fields, label_search, page_sources, region_tables, anchors, typed_export, reports, templates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
