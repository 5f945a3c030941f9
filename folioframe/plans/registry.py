"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans import library, story


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return library.QUERIES | story.QUERIES


def oracle_sql() -> dict[str, str]:
    return library.SQL | story.SQL
