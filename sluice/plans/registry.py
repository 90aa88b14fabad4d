"""Registered queries: a callable per operator and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .checks import with_views

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK: dict[str, str] = {}
RAW: dict[str, str] = {}
SURVEY: dict[str, str] = {}


def query(name: str, row: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` for survey row ``row``."""

    def add(fn):
        if name in RUN:
            raise ValueError(f"query {name} registered twice")
        RUN[name] = fn
        SURVEY[name] = row
        if sql is not None:
            RAW[name] = sql
            CHECK[name] = with_views(sql)
        return fn

    return add
