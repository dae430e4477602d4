"""All registered analytics queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_jobs, queries_pixels, queries_results, queries_scores, queries_store

_PARTS = (queries_scores, queries_pixels, queries_results, queries_store, queries_jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.ORACLES.items()}
