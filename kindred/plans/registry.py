"""The queries over the library's own operators by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query function (spark, sf_dir), and the SQL that has to give the same rows."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from . import decisions, features, linkage, models, stores, streams  # noqa: F401
