"""Registered queries over the given tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annotation_queries, catalog_queries, file_queries, mask_queries, more_queries, pixel_queries
from .fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (catalog_queries, pixel_queries, annotation_queries, mask_queries, more_queries, file_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of every image, by file."""
    return queries()["s14_write_yolo_detect"](spark, sf_dir).where("path LIKE 'labels/%'").select("path", "content")


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for module in _MODULES for name, sql in module.SQL.items()}
