"""All queries of the library, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanveil.plans import contracts, derived, exchange, places, sessions, tables, text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each takes (spark, sf_dir)."""
    return text.QUERIES | tables.QUERIES | contracts.QUERIES | sessions.QUERIES | places.QUERIES | derived.QUERIES | exchange.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return text.ORACLES | tables.ORACLES | contracts.ORACLES | sessions.ORACLES | places.ORACLES | derived.ORACLES | exchange.ORACLES
