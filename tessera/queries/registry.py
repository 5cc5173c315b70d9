"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, events, graphs, lifecycle, searches
from .fixtures import Tables

_MODULES = (searches, graphs, lifecycle, events, corpus)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for module in _MODULES:
        for name, (run, _) in module.QUERIES.items():
            found[name] = lambda spark, sf_dir, run=run: run(Tables(spark, sf_dir))
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
