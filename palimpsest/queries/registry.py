"""The query registry: a name, a function from inputs to a DataFrame, and its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans.base import Inputs, inputs
from palimpsest.queries.sqlkit import with_ctes

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)``; ``sql`` may name shared table expressions, which are put in front of it."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracle_text() -> dict[str, str]:
    """Every check as one self-contained statement."""
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](inputs(spark, sf_dir))

    return run
