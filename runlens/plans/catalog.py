"""Names of queries and of their SQL twins.

A query is a function of the telemetry views; query() registers it under its name, with SQL over the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.sources.telemetry import SQL_VIEWS, Telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Telemetry. sql: a select over the views, or ", name as (...) select ..." to add views."""

    def register(f: Callable[[Telemetry], DataFrame]):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Telemetry(spark, sf_dir))
        if sql:
            ORACLES[name] = f"with {SQL_VIEWS}{sql.strip()}"
        return f

    return register


def load() -> None:
    """Imports every module that registers queries."""
    from . import aggregates, alignments, anomalies, context, curves, decompositions, joins, merges, more_sequences, profiles, sequences, statistics, stores, streams, texts, views  # noqa: F401
