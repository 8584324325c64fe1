"""Commit logs printed by git, one text per repository, as commit and file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.functions import paths as P

_RECORD, _FIELD = "\x1e", "\x1f"


def _records(logs: DataFrame) -> DataFrame:
    """Log records split inside the row, as JVM expressions, in print order."""
    return logs.select("repo_id", F.posexplode(F.split("text", _RECORD)).alias("seq", "rec")) \
        .filter(F.trim(F.regexp_replace("rec", r"\s", "")) != "") \
        .withColumn("lines", F.split("rec", "\n"))


def parse_git_log(logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, commit_files, errors) of ``logs(repo_id, text)`` in name-status format.

    A record whose header has not five fields or no readable date is an error row.
    """
    rows = _records(logs).withColumn("f", F.split(F.col("lines")[0], _FIELD)) \
        .withColumn("ts", F.try_to_timestamp(F.get("f", F.lit(3))))
    good = (F.size("f") == 5) & F.col("ts").isNotNull()
    commits = rows.filter(good).select(
        "repo_id", F.col("f")[0].alias("sha"), F.col("f")[1].alias("author"), F.col("f")[2].alias("author_email"),
        "ts", F.col("f")[4].alias("subject"), "seq")
    parts = F.split("line", "\t")
    files = rows.filter(good).select("repo_id", F.col("f")[0].alias("sha"),
                                     F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")) \
        .withColumn("p", parts).filter(F.size("p").isin(2, 3)).select(
            "repo_id", "sha", F.col("p")[0].alias("status"), F.element_at("p", -1).alias("path"),
            F.when(F.size("p") == 3, F.col("p")[1]).alias("old_path"))
    errors = rows.filter(~good).select("repo_id", "seq", F.col("lines")[0].alias("header"))
    return commits, files, errors


def parse_numstat_lines(rows: DataFrame) -> DataFrame:
    """Added, deleted and path of numstat rows in column ``text``; rows without three fields are skipped."""
    parts = F.split("text", "\t", 3)
    number = lambda i: F.coalesce(F.col("_p")[i].try_cast("int"), F.lit(0))
    return rows.withColumn("_p", parts).filter(F.size("_p") == 3) \
        .withColumn("added", number(0)).withColumn("deleted", number(1)) \
        .withColumn("path", P.renamed_path(F.col("_p")[2])).drop("_p", "text")


def parse_numstat(logs: DataFrame) -> DataFrame:
    """(repo_id, sha, seq, added, deleted, path) of ``logs(repo_id, text)`` in numstat format."""
    rows = _records(logs).select("repo_id", F.trim(F.col("lines")[0]).alias("sha"), "seq",
                                 F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("text"))
    return parse_numstat_lines(rows.filter("text != ''"))
