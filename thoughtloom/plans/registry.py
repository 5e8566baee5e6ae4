"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composed_queries, more_queries, service_queries  # noqa: F401  (they register their queries)
from . import queries as _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.SQL)
