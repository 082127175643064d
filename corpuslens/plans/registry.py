"""Where each runnable query meets its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpuslens.session import ship

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
TWINS: dict[str, str] = {}


def shipped(fn: QueryFn) -> QueryFn:
    """The query, after its package has been given to the Python workers."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def bind(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = shipped(fn)
        if sql is not None:
            TWINS[name] = sql
        return fn

    return bind
