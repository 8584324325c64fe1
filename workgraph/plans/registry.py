"""The queries of every family and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workgraph.plans.adapters import check_sql, table
from workgraph.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Views by attribute: ``t.issues`` is the issues view of this data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, check: str | None = None):
    """Register a query over :class:`Tables`, with the SQL that must give the same rows."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(tune(spark), sf_dir))
        if check:
            CHECKS[name] = check_sql(check)
        return fn
    return add
