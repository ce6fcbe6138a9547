"""Registry of the engine's own queries, with their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from termloom import queries as package

    for m in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{m.name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["term_feature_npmi"](spark, sf_dir)
