"""Registered queries: a Spark callable per operator and, where SQL can say it, the expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata_checks.derived import Data, with_derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register `build(data)` under `name`; `sql` may use `{table}` for shipped and derived tables."""
    def register(build: Callable[[Data], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_derived(sql)
        return build
    return register
