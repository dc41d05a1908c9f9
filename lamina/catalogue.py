"""Every registered query of the library's own operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.plans import compositions, measures, models, resampling, sequences, spatial, validation  # noqa: F401
from lamina.plans.registry import PLANS, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
