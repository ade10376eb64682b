"""All named queries of the library and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, large, payloads, people, records, reports, trees

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (people, records, reports, trees, payloads, large, files)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
