"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bars, evaluation, files, indicators, portfolio, quality, range_job, stores
from .base import ORACLES, QUERIES

__all__ = ["bars", "evaluation", "files", "indicators", "oracle_sql", "portfolio", "quality", "queries", "range_job", "stores"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
