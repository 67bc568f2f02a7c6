"""All registered queries of the core and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tutorgrain.plans import checking, dialogue, judging, nested, scores, search

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [nested, dialogue, search, scores, judging, checking]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in getattr(module, "SQL", {}).items()}
