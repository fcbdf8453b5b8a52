"""Operators for training-data corpora and their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog

    return dict(catalog.QUERIES)


def llm_sql() -> dict[str, str]:
    from . import catalog

    return dict(catalog.SQL)
