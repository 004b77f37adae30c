"""Registry of ready-made queries over the sample tables, with comparison SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesflow.catalog.views import with_views
from salesflow.sources.sample_tables import Sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(sample) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Sample], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Sample(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql.strip(), extra)
        return fn

    return add


def load() -> None:
    from salesflow.catalog import features, forecasting, ingest, scalars, serving, sinks, storage, streams, trees, validation  # noqa: F401
