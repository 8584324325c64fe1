"""The corpus pipeline as a query. ``corpus_pipeline`` itself imports the operators, so it is imported when it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workgraph.llm.registry import QUERIES


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
