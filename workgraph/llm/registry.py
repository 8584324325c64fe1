"""The queries of this folder and the SQL they are checked against; importing it registers all of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workgraph.session import CLEAN_SHUFFLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Rows and bytes handed to a Python worker at once, so that a batch of long texts stays small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def settings(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: bounded Arrow batches, splitting of skewed joins, and no shuffle files beyond their action."""
    for key, value in {**BATCH, "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
                       "spark.sql.adaptive.forceOptimizeSkewedJoin": "true", CLEAN_SHUFFLES: "true"}.items():
        spark.conf.set(key, value)
    return spark


def query(name: str, check: str | None = None):
    """Register ``fn(spark, read)``, where ``read(table)`` is a table of the data folder."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(settings(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if check:
            CHECKS[name] = check
        return fn
    return add


for _module in ["quality_rules", "secret_scan", "decontamination", "mixing", "html_text", "quality_gam", "toxicity", "jaccard_join", "license_scan", "suffix_dedup",
                "source_audit", "spelling", "vector_search", "pipeline_query"]:
    importlib.import_module(f"workgraph.llm.{_module}")
