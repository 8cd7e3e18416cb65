"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, intake, ledger, problems, review, signals, streams, surface

MODULES = (problems, ledger, analytics, surface, intake, review, signals, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.row_scores(spark, sf_dir)
