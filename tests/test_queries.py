"""One query per family against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from workgraph.plans import CHECKS, QUERIES
from workgraph.plans.adapters import BASE
from workgraph.session import tune

SF = "/root/testdata/sf0.001"
NAMES = ["companion_hotspots", "open_blockers", "next_queue", "parse_entries", "pair_rows", "parse_patches", "refresh_states", "changed_symbols",
         "implements", "feature_outline", "score_cases", "md_blocks", "stream_fold", "run_log"]


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in BASE:
        con.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


def shape(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(str([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, base, name):
    got, want = QUERIES[name](spark, SF), base.sql(CHECKS[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert shape(got.columns, [tuple(r) for r in got.collect()]) == shape(want.columns, want.fetchall())


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES) and len(CHECKS) > 180


def test_scans_of_a_query_are_in_small_pieces(spark, tmp_path):
    """A task's share of a table is bounded in bytes, not by the number of cores."""
    rows = spark.range(6_000_000).selectExpr("xxhash64(id) AS a", "xxhash64(id, 1) AS b")
    rows.coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(f"{tmp_path}/t")
    held = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        read = tune(spark).read.parquet(f"{tmp_path}/t")
        assert read.rdd.getNumPartitions() >= 6
        grouped = read.groupBy("a").count().withColumn("p", F.spark_partition_id()).select("p").distinct().count()
        assert grouped == 4  # as many as the session's shuffle partitions: none are joined into larger ones
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
