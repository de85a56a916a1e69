"""Registered queries: each runs an operator over the given tables, most with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from ..views import Tables
from .oracle import with_views

REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False, views: dict[str, str] | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, recursive, views)
        return fn

    return register


_TABLES: WeakKeyDictionary = WeakKeyDictionary()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The views of a folder; their plans (not their rows) are kept for the session."""
    return _TABLES.setdefault(spark, {}).setdefault(sf_dir, Tables(spark, sf_dir))


def _settle(spark: SparkSession) -> None:
    """UTC times for every session; as many shuffle partitions as cores where a local one kept the default."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))


def _bound(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _settle(spark)
        return fn(tables(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import accounts, condensing, filters, ingestion, joins, routing, search, sources, streams  # noqa: F401

    return {name: _bound(fn) for name, fn in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
