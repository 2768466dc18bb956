"""Named queries of the engine over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chromalake.plans import library


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(library.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(library.SQL)
