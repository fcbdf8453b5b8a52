"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from . import ingest, measuring, modelling, neighbours, preparing, running  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .common import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from .common import SQL

    _load()
    return dict(SQL)
